"""Helpers of the text operators: checkpoints, Arrow text blocks, word and shingle hashes.

Words are the maximal runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A null
text counts as empty everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.session import ensure_checkpoint_dir

BLOCK_BYTES = 1 << 19
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that spark.checkpoint.dir names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_part(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return crc_part(doc_id) == 2


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow text column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in blocks of about `limit` bytes; a longer text is a block of its own."""
    for batch in batches:
        data, offsets = strings(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (a bijection of 64-bit words)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.ones(n, dtype=np.uint64)
            p[1:] = base
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of all words and, per text, the index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _LOWER) -> np.ndarray:
    """64-bit hash of each byte span; `table` maps bytes to values."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles.

    A text with fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    start, end, first = words(data, offsets)
    word = span_hashes(data, start, end)
    long = word[: max(0, len(word) - size + 1)].copy()
    for j in range(1, size):
        long = long * _BASE + word[j : len(word) - size + 1 + j]
    long = mix(long)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(long[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _BASE + w
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sample_ids(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, label): at most `per_label` rows of each label, the first by a hash of the id.

    Rows without id or label are left out; an id with several labels counts once, with its
    smallest. The window's limit is applied before the shuffle, so no label is gathered whole.
    """
    known = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return known.withColumn("rank", rank).where(F.col("rank") <= per_label).drop("rank")


def sample_texts(documents: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """Whole texts of sampled ids on the driver: text and label, in order of the id and the text.

    `ids` is bounded by its sample; it is the broadcast side.
    """
    picked = F.broadcast(ids.select(F.col("doc_id").alias("picked"), "label"))
    found = documents.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("picked")).where("text IS NOT NULL")
    return found.select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"], kind="stable", ignore_index=True)

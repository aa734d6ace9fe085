"""Packing of tokenized documents into sequences by cutting-stock column generation.

Every document is cut into full sequences and one remainder. Remainders are counted by length;
this histogram (at most CAPACITY - 1 numbers, whatever the corpus) is the demand of a
cutting-stock problem. Its linear program is solved by column generation: a knapsack dynamic
programme over exact totals prices new patterns, a revised simplex with an explicit inverse takes
them in. The program counts in units of 1 / UNITS of a sequence, rounded up. Its patterns are
carried out in true lengths: what the units leave free takes further remainders, the largest that
fit, and a best fit places what rounding leaves. Where best fit alone needs fewer sequences, it is
taken. The remainders are ranked within their length and take their places by rank.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.llm.common import checkpointed, shuffle_partitions

CAPACITY = 1024
CACHE_CHUNKS = 50_000
BLOCK_CHARS = 1 << 18
UNITS = 128
MAX_PRICINGS = 400
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# --- tokens


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and id of every token of a byte-level vocabulary whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as file:
        kept = json.load(file)
    if kept["model"]["type"] != "BPE" or (kept["pre_tokenizer"] or {}).get("type") != "ByteLevel" or kept["normalizer"] or kept["pre_tokenizer"]["add_prefix_space"]:
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"] for t in kept["added_tokens"]}
    vocabulary = {t: i for t, i in kept["model"]["vocab"].items() if t not in added}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in kept["model"]["merges"]]
    return {bytes(signs[c] for c in t): i for t, i in vocabulary.items()} if merged == sorted(merged) else None


class Tokens:
    """Token ids of texts as packed little-endian words, with a bounded cache of chunks.

    A single space between two non-spaces begins a new piece of the vocabulary's pattern
    whatever follows, so what lies between such spaces is encoded by itself and kept. Chunks of a
    byte-level vocabulary are merged by its ranks. Texts that hold an added token's string are
    encoded whole by the tokenizer, which is loaded where something needs it.
    """

    SPLIT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file)["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merges = None
        if ranks := byte_ranks(path):
            self.merges = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        return [array("I", self.merges.encode_ordinary(c)).tobytes() for c in chunks] if self.merges else self._encode(chunks)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for text in texts:
            if any(a in text for a in self.added):
                cut.append(None)
            elif "\0" in text or re.search(r"\s\s", text) or text[:1].isspace() or text[-1:].isspace():
                first, *rest = self.SPLIT.split(text)
                cut.append([first, *[" " + c for c in rest]])
            else:
                cut.append(text.replace(" ", "\0 ").split("\0"))
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        wanted = set().union(*[c for c in cut if c]).difference(known)
        found = {c: older[c] for c in wanted if c in older}
        known.update(found)
        new = list(wanted.difference(found))
        known.update(zip(new, self._chunks(new)))
        return [self._encode([t])[0] if chunks is None else b"".join(map(known.__getitem__, chunks)) for t, chunks in zip(texts, cut)]


def _cut(path: str, capacity: int):
    """Documents to their pieces, in order: full sequences, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            row = 0
            while row < len(ids):
                part, size = [], 0
                while row + len(part) < len(ids) and size < BLOCK_CHARS:
                    part.append(texts[row + len(part)].as_py() or "")
                    size += len(part[-1])
                out: list[tuple] = []
                for doc_id, packed in zip(ids[row : row + len(part)], tokens.encode(part)):
                    packed += b"\0\0\0\0"
                    n = len(packed) // 4
                    for start in range(0, n, capacity):
                        piece = packed[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                row += len(part)
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def cut_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of (doc_id, text); each document ends with id 0, so none is empty."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity), PIECES)


# --- cutting stock (on the driver, on one number per length class)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over exact totals: best value of each and the last class taken (-1: not reached)."""
    best = np.full(capacity + 1, -np.inf)
    last = np.full(capacity + 1, -1)
    best[0] = 0.0
    for c in range(int(sizes[0]), capacity + 1):
        fit = sizes[: np.searchsorted(sizes, c, "right")]
        values = best[c - fit] + duals[: len(fit)]
        i = int(np.argmax(values))
        if values[i] > -np.inf:
            best[c], last[c] = values[i], i
    return best, last


def _pattern(total: int, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    column = np.zeros(len(sizes))
    while total > 0:
        column[last[total]] += 1
        total -= int(sizes[last[total]])
    return column


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns of the cutting-stock linear program that covers the demand, and how often each is used.

    The simplex starts from patterns of one class each. Every pricing offers the best pattern
    of all and the best one that holds each class; the programme ends when none gains.
    """
    m = len(sizes)
    fill = capacity // sizes
    basis = [np.eye(m)[i] * fill[i] for i in range(m)]
    inverse, x = np.diag(1.0 / fill), demand / fill
    for _ in range(MAX_PRICINGS):
        duals = inverse.sum(axis=0)  # every sequence costs one
        best, last = price(duals, sizes, capacity)
        up_to = np.maximum.accumulate(best)  # the best of all totals up to this one
        at = np.maximum.accumulate(np.where(best == up_to, np.arange(capacity + 1), 0))
        columns = [_pattern(int(at[capacity]), last, sizes)]
        for i in np.flatnonzero(duals + up_to[capacity - sizes] > 1 + 1e-7):
            columns.append(_pattern(int(at[capacity - sizes[i]]), last, sizes))
            columns[-1][i] += 1
        moved = False
        for column in columns:
            way = inverse @ column
            if way.sum() <= 1 + 1e-7:  # its value by the duals of now
                continue
            ratio = np.full(m, np.inf)
            np.divide(x, way, out=ratio, where=way > 1e-9)
            out = int(np.argmin(ratio))
            x = np.maximum(x - ratio[out] * way, 0.0)
            x[out] = ratio[out]
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            basis[out], moved = column, True
        if not moved:
            break
    return list(zip(basis, x))


def _fill(sizes: np.ndarray, left: np.ndarray, taken: np.ndarray, room: int) -> np.ndarray:
    """The pattern with what still fits beside it, the largest first."""
    taken = taken.copy()
    spare = left - taken
    top = int(np.searchsorted(sizes, room, "right"))
    while top:
        held = np.flatnonzero(spare[:top])
        if not len(held):
            break
        i = int(held[-1])
        count = min(int(spare[i]), room // int(sizes[i]))
        taken[i] += count
        room -= count * int(sizes[i])
        top = min(i, int(np.searchsorted(sizes, room, "right")))
    return taken


def _carry_out(patterns: list[tuple[np.ndarray, int]], sizes: np.ndarray, left: np.ndarray, first: np.ndarray, capacity: int, refill: bool) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) that follow patterns of classes, each of the sizes from `first` on, as
    long as there are pieces; then sequences without a pattern. With `refill` the smallest piece of
    a pattern gives way to those that fit best."""
    left, out = left.copy(), []
    ends = np.append(first[1:], len(sizes))

    def use(taken: np.ndarray, most: int) -> int:
        held = np.flatnonzero(taken)
        times = min(most, int((left[held] // taken[held]).min()))
        left[held] -= times * taken[held]
        out.append((times, {int(sizes[i]): int(taken[i]) for i in held}))
        return times

    for wanted, todo in patterns:
        while todo:
            taken = np.zeros(len(sizes), dtype=np.int64)
            for c in np.flatnonzero(wanted):
                need = int(wanted[c])
                for i in range(int(ends[c]) - 1, int(first[c]) - 1, -1):
                    taken[i] = min(need, int(left[i]))
                    need -= int(taken[i])
            held = np.flatnonzero(taken)
            if not len(held):  # sequences before took them all
                break
            if refill:
                taken[held[0]] -= taken.sum() > 1
                taken = _fill(sizes, left, taken, capacity - int(taken @ sizes))
            todo -= use(taken, todo)
    while left.any():
        use(_fill(sizes, left, np.zeros(len(sizes), dtype=np.int64), capacity), int(left.sum()))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) of all sequences for the remainders counted by size.

    Of the program's patterns as they are, the same refilled, and best fit alone, the one with the
    fewest sequences.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(n)] for n in sizes], dtype=np.int64)
    unit = max(1, capacity // UNITS)
    classes, first = np.unique(-(-sizes // unit), return_index=True)
    used = solve(classes, np.add.reduceat(left, first), capacity // unit)
    patterns = [(column.astype(np.int64), int(x + 1e-6)) for column, x in sorted(used, key=lambda p: -p[1])]
    ways = ((patterns, False), (patterns, True), ([], False))
    return min((_carry_out(p, sizes, left, first, capacity, refill) for p, refill in ways), key=lambda plan: sum(times for times, _ in plan))


def places(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Where the pieces of each size go: ranks from `first_rank` on take `count` places in each of
    the sequences that begin with `first_sequence`."""
    rows, used, sequence = [], {}, 0
    for times, taken in patterns:
        for size, count in taken.items():
            rank = used.get(size, 0)
            rows.append((size, rank, rank + times * count, count, sequence))
            used[size] = rank + times * count
        sequence += times
    return pd.DataFrame(rows, columns=["size", "first_rank", "end_rank", "count", "first_sequence"])


# --- the packing


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Pieces with a rank, gapless from 0 among those of their size.

    Ranks are counted within salts first; the counts of (size, salt) shift them, so a size that
    a third of all documents share is spread over all tasks.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select(F.col("size").alias("size_"), F.col("salt").alias("salt_"), F.coalesce(before, F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return (
        salted.withColumn("inside", inside)
        .join(shifts, (F.col("size") == F.col("size_")) & (F.col("salt") == F.col("salt_")))
        .withColumn("rank", F.col("inside") + F.col("shift")).drop("salt", "inside", "size_", "salt_", "shift")
    )


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset.

    Null and empty texts are the single id 0. Rows without an id and rows that repeat one are
    packed like any other. An empty table gives no rows; other columns are not looked at.
    """
    pieces = checkpointed(cut_documents(documents, tokenizer, capacity)).withColumn("size", F.col("length"))
    parts = pieces.where(F.col("length") < capacity)
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than capacity rows
    patterns = plan(histogram, capacity)
    # as Arrow the places reach the JVM without Python workers beside those of the pieces
    where = spark.createDataFrame(pa.Table.from_pandas(places(patterns).astype("int64"), preserve_index=False))
    ranked = _ranked(pieces.withColumn("size", F.when(F.col("length") < capacity, F.col("size")).otherwise(F.lit(0))), shuffle_partitions(spark))
    # the places are bounded by the lengths, not by the rows
    packed = ranked.join(F.broadcast(where), "size").where("rank >= first_rank AND rank < end_rank")
    packed = packed.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("count")))
    # a sequence holds at most `capacity` pieces
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("size", "rank").rowsBetween(W.unboundedPreceding, -1))
    packed = packed.withColumn("offset", F.coalesce(before, F.lit(0)))
    whole = ranked.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("rank") + sum(times for times, _ in patterns), "offset": F.lit(0).cast("bigint")})
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(columns).unionByName(whole.select(columns))

"""Quality by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is trained on good labelled texts and one on bad ones. The difference of
a text's two compressed sizes, divided by its own size, is a score that a logistic curve turns
into a chance. Dictionaries and curve come from separate parts of a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import held_out, sample_ids, sample_texts, strings

PER_LABEL = 3000
DICTIONARY_BYTES = 1 << 18
CHUNK_BYTES = 2000
LEVEL = 3
PIECE_BYTES = 500
GOOD = 0.7
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _chunks(texts: list[bytes]) -> list[bytes]:
    return [t[i : i + CHUNK_BYTES] for t in texts for i in range(0, len(t), CHUNK_BYTES)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """Dictionary of sample texts; the texts themselves where they are too few to train one."""
    chunks = _chunks(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[:DICTIONARY_BYTES]


@dataclass
class Model:
    """Two dictionaries and the curve 1 / (1 + exp(-(slope x difference + shift)))."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0

    def compressors(self) -> tuple:
        def make(raw: bytes):
            kept = zstandard.ZstdCompressionDict(raw) if raw else None
            if kept is not None:
                kept.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)

        return make(self.good), make(self.bad)

    def scores(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -60, 60)))


def difference(text: bytes, compressors: tuple) -> float:
    """How much smaller the good dictionary makes the text, as a share of its size; 0 if it is empty.

    Pieces are compressed one by one, so that a long text does not become its own dictionary.
    """
    if not len(text):
        return 0.0
    good, bad = (sum(len(c.compress(text[i : i + PIECE_BYTES])) for i in range(0, len(text), PIECE_BYTES)) for c in compressors)
    return (bad - good) / len(text)


def calibrate(values: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, classes weighted as they occur."""
    scale = max(float(np.abs(values).max(initial=0.0)), 1e-9)
    x = np.column_stack((values / scale, np.ones(len(values))))
    weight = np.zeros(2)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (label - chance) - 1e-2 * weight
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + 1e-2 * np.eye(2)
        weight = weight + np.clip(np.linalg.solve(curve, slope), -5, 5)
    return float(weight[0] / scale), float(weight[1])


def fit(texts: list[str], label: np.ndarray) -> Model:
    """Every third text of the sample calibrates, the others build the dictionaries."""
    raw, label = [t.encode() for t in texts], np.asarray(label, dtype=float)
    curve = np.arange(len(raw)) % 3 == 2
    parts = [[raw[i] for i in np.flatnonzero(~curve & (label == k))] for k in (1, 0)]
    model = Model(*(build_dictionary(p) for p in parts))
    if not curve.any() or not all(parts):
        share = float(label.mean()) if len(label) else 0.5
        model.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    tools = model.compressors()
    values = np.array([difference(raw[i], tools) for i in np.flatnonzero(curve)])
    model.slope, model.shift = calibrate(values, label[curve])
    return model


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Model from at most `per_label` texts of each label, none of the held-out ids."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    sample = sample_texts(documents, sample_ids(rows, "quality", per_label))
    return fit(sample["text"].to_list(), sample["label"].to_numpy())


def _score(model: Model, good: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            data, offsets = strings(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            score = model.scores(np.array([difference(view[a:b], tools) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.float64))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= good).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def quality(documents: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """Score and verdict for every row of (doc_id, text).

    Null and empty texts get the score of a difference of zero. Null and repeated ids are kept
    as they are; an empty table gives no rows; without labels every score is the share of good
    ones (a half if there is none). Other columns are not looked at.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model, good), SCHEMA)

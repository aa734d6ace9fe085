"""Language identification in two steps: the family first, then a vote within it.

Families are learned: languages are joined by the likeness of their average byte n-gram
profiles until about the square root of their number is left. One linear support vector machine
per pair of families, and within a family one per pair of its languages, is trained on a bounded
sample of texts per language; each votes with its margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import held_out, sample_ids, sample_texts, text_blocks

DIMENSIONS = 4096
PER_LANGUAGE = 500
NOTHING = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, family bigint"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += np.uint32(32)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# digits and marks say little about a language: they count as one sign
_LOWER[[*range(33, 65), *range(91, 97), *range(123, 128)]] = 33


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the square roots of its hashed byte 1- to 4-gram shares: a vector of length one or zero."""
    low = _LOWER[data]
    grams = [low]
    for _ in range(3):
        grams.append((grams[-1][:-1] << np.uint32(8)) | low[len(grams) :])
    # multiplicative hashing of up to four bytes to twelve bits, another factor for each length
    places = [(g * np.uint32(2654435761 + 40503 * 2 * n) >> np.uint32(20)).astype(np.int16) for n, g in enumerate(grams)]
    out = np.zeros((len(offsets) - 1, DIMENSIONS), dtype=np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        parts = [p[a : max(a, b - n)] for n, p in enumerate(places)]
        count = np.bincount(np.concatenate(parts), minlength=DIMENSIONS)
        out[i] = np.sqrt(count / max(1, count.sum()))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    at = np.flatnonzero(_ASCII_LETTER[data])
    out = np.diff(np.searchsorted(at, offsets)) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def svm(x: np.ndarray, sign: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine: gradient steps on the squared hinge loss, classes weighted alike."""
    weight, bias = np.zeros(x.shape[1], dtype=x.dtype), 0.0
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    m = v = 0.0
    for step in range(1, steps + 1):
        loss = np.maximum(0.0, 1 - sign * (x @ weight + bias)) * sign * share
        slope = np.append(loss.astype(x.dtype) @ x - ridge * weight, loss.sum())
        m = 0.9 * m + 0.1 * slope if step > 1 else 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2 if step > 1 else 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight + move[:-1].astype(x.dtype), bias + move[-1]
    return weight, bias


def learn_families(x: np.ndarray, names: np.ndarray) -> dict[str, int]:
    """Family of each language: average linkage of the languages' mean profiles."""
    languages = sorted(set(names))
    means = np.stack([x[names == n].mean(axis=0) for n in languages])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like, groups = means @ means.T, [[i] for i in range(len(languages))]
    while len(groups) > max(1, round(len(languages) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: like[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return {languages[i]: k for k, g in enumerate(groups) for i in g}


@dataclass
class Votes:
    """One machine per pair of classes; a class gets the margins of its machines as votes."""

    names: list
    weights: np.ndarray
    biases: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, label: np.ndarray) -> Votes:
        names, machines = sorted(set(label.tolist())), []
        for a, b in combinations(names, 2):
            rows = (label == a) | (label == b)
            machines.append(svm(x[rows], np.where(label[rows] == a, 1.0, -1.0)))
        return cls(names, np.array([w for w, _ in machines]).reshape(len(machines), x.shape[1]).astype(np.float32), np.array([b for _, b in machines]))

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Chance of each class: the mean of the logistic votes of its pairs, made to add up to one."""
        if len(self.names) == 1:
            return np.ones((len(x), 1))
        vote = 1 / (1 + np.exp(-np.clip(4 * (x @ self.weights.T + self.biases), -40, 40)))
        total = np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(combinations(range(len(self.names)), 2)):
            total[:, a] += vote[:, k]
            total[:, b] += 1 - vote[:, k]
        return total / total.sum(axis=1, keepdims=True)


@dataclass
class Model:
    families: Votes
    within: dict[int, Votes]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, list[int | None]]:
        """Language, score (family share x share within it) and family of each text."""
        n = len(offsets) - 1
        names, score, found = [NOTHING] * n, np.zeros(n), [None] * n
        letters = has_letter(data, offsets)
        if not self.families.names:
            return names, score, found
        x = profiles(data, offsets)
        share = self.families.shares(x)
        best = share.argmax(axis=1)
        for k, family in enumerate(self.families.names):
            rows = np.flatnonzero((best == k) & letters)
            if len(rows):
                votes = self.within[family]
                inner = votes.shares(x[rows])
                pick = inner.argmax(axis=1)
                score[rows] = share[rows, k] * inner.max(axis=1)
                for i, p in zip(rows, pick):
                    names[i], found[i] = votes.names[p], int(family)
        return names, score, found


def fit(texts: list[str], languages: list[str], families: dict[str, int] | None = None) -> Model:
    if not texts:
        return Model(Votes([], np.zeros((0, DIMENSIONS)), np.zeros(0)), {})
    raw = [t.encode() for t in texts]
    x = profiles(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    names = np.array(languages, dtype=object)
    family = families or learn_families(x, names)
    groups = np.array([family[n] for n in names])
    return Model(Votes.train(x, groups), {int(g): Votes.train(x[groups == g], names[groups == g]) for g in set(groups.tolist())})


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, int] | None = None) -> Model:
    """Model from at most `per_language` texts of each language that is not null, none held out."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sample = sample_texts(documents.where("lang IS NOT NULL"), sample_ids(rows, "lang", per_language))
    return fit(sample["text"].to_list(), sample["label"].to_list(), families)


def _identify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            names, score, family = model.predict(data, offsets)
            columns = [rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(family, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Predicted language, score and family for every row of (doc_id, text).

    Null texts and texts without a letter are `und` with score 0, and so is everything if the
    model has no language. Null and repeated ids are kept as they are; an empty table gives no
    rows; other columns are not looked at.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_identify(model), SCHEMA)

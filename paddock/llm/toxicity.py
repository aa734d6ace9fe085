"""Toxicity by cumulative-link ordinal regression on sparse word features.

Features are whole words and word beginnings, by hash. Those that tell toxic from other labelled
texts are kept; how many of them a toxic text holds gives its severity grade (terciles), 0 being
not toxic. One weight vector is shared by all ordered thresholds:
P(grade <= k) = 1 / (1 + exp(weights . x - threshold_k)), x holding log(1 + count) per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import held_out, mix, sample_ids, sample_texts, span_hashes, text_blocks

GRADES = 3
PER_LABEL = 3000
FEATURES = 800
STARTS = (4, 5)
REJECT = 0.35
SCHEMA = "doc_id bigint, severity double, toxic_probability double, grade bigint, toxic boolean"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of every word and of its beginnings; words are runs of letters."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    texts, hashes = [text], [span_hashes(data, start, end, _LOWER)]
    for n in STARTS:
        long = end - start > n
        texts.append(text[long])
        hashes.append(mix(span_hashes(data, start[long], start[long] + n, _LOWER) + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@dataclass
class Model:
    """A trained regression: sorted feature hashes, their weights, and ordered thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) of the features that occur."""
        if not len(self.hashes):
            nothing = np.zeros(0, dtype=np.int64)
            return nothing, nothing, nothing
        text, found = word_features(data, offsets)
        # a small bitmap by the low bits lets most words pass without a search
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        keep = seen[(found & np.uint64(0xFFFF)).astype(np.int64)]
        text, found = text[keep], found[keep]
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[place] == found
        pair, count = np.unique(text[hit] * len(self.hashes) + place[hit], return_counts=True)
        return pair // len(self.hashes), pair % len(self.hashes), count

    def above(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold k."""
        text, feature, count = self.counts(data, offsets)
        total = np.bincount(text, weights=self.weights[feature] * np.log1p(count), minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - total[:, None], -60, 60)))


def _text_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts and the number of texts that have each, counted in blocks."""
    names, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for a in range(0, len(texts), 200):
        text, found = word_features(*_pack(texts[a : a + 200]))
        local, place = np.unique(found, return_inverse=True)
        pair = np.unique(text.astype(np.int64) * len(local) + place)
        both = np.concatenate((names, local))
        names, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, np.bincount(pair % len(local), minlength=len(local)))), minlength=len(names)).astype(np.int64)
    return names, counts


def choose_features(texts: list[str], toxic: np.ndarray, limit: int) -> np.ndarray:
    """Hashes whose share of toxic texts stands out most from their share of the others."""
    names, bad = _text_counts([t for t, y in zip(texts, toxic) if y])
    others, counts = _text_counts([t for t, y in zip(texts, toxic) if not y])
    place = np.minimum(np.searchsorted(others, names), len(others) - 1)
    good = np.where(others[place] == names, counts[place], 0) if len(others) else np.zeros(len(names), dtype=np.int64)
    share = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    deviation = share / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    best = np.lexsort((names, -deviation))[:limit]
    return np.sort(names[best[(deviation[best] > 3) & (bad[best] >= 3)]])


def fit(texts: list[str], toxic: np.ndarray, limit: int = FEATURES, steps: int = 300, ridge: float = 1e-3) -> Model:
    """Grades, then shared weights and thresholds by gradient steps on the ordinal likelihood."""
    toxic = np.asarray(toxic, dtype=bool)
    hashes = choose_features(texts, toxic, limit) if toxic.any() and not toxic.all() else np.zeros(0, dtype=np.uint64)
    model = Model(hashes, np.zeros(len(hashes)), np.log(np.arange(1, GRADES + 1)) + 1.0)
    if not len(hashes):
        return model
    x, marks = np.zeros((len(texts), len(hashes)), dtype=np.float32), np.zeros(len(texts))
    for a in range(0, len(texts), 200):
        text, feature, count = model.counts(*_pack(texts[a : a + 200]))
        x[a + text, feature] = np.log1p(count)
        marks[a : a + 200] = np.bincount(text, weights=count, minlength=len(texts[a : a + 200]))
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(marks[toxic], np.arange(1, GRADES) / GRADES), marks, "left"), 0)
    # thresholds are a first value and positive steps, so that they stay ordered
    weight, first, steps_up = np.zeros(len(hashes)), 1.0, np.zeros(GRADES - 1)
    params = [weight, np.array([first]), steps_up]
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    rows = np.arange(len(texts))
    for step in range(1, steps + 1):
        theta = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[2]))))
        total = x @ params[0].astype(np.float32)
        low = np.concatenate((theta, [np.inf]))[grade] - total
        high = np.concatenate(([-np.inf], theta))[grade] - total
        up, down = 1 / (1 + np.exp(-np.clip(low, -40, 40))), 1 / (1 + np.exp(-np.clip(high, -40, 40)))
        up[grade == GRADES], down[grade == 0] = 1.0, 0.0
        chance = np.maximum(up - down, 1e-9)
        at_up, at_down = up * (1 - up) / chance, down * (1 - down) / chance
        by_theta = np.zeros((len(texts), GRADES))
        by_theta[rows[grade < GRADES], grade[grade < GRADES]] += at_up[grade < GRADES]
        by_theta[rows[grade > 0], grade[grade > 0] - 1] -= at_down[grade > 0]
        each = by_theta.mean(axis=0)
        tail = np.array([each[k + 1 :].sum() for k in range(GRADES - 1)])
        slopes = [(at_down - at_up).astype(np.float32) @ x / len(texts) - ridge * params[0], np.array([each.sum()]), tail * np.exp(params[2])]
        for p, slope, (m, v) in zip(params, slopes, memory):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(params[0], 0.0, out=params[0])  # every kept feature is one of toxic texts
    theta = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[2]))))
    return Model(hashes, params[0], theta)


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Model from at most `per_label` toxic and as many other labelled texts, none of the held-out ids."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    sample = sample_texts(documents, sample_ids(rows, "toxic", per_label))
    return fit(sample["text"].to_list(), sample["label"].to_numpy(dtype=bool))


def _score(model: Model, reject: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            above = model.above(data, offsets)
            columns = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(axis=1).astype(np.int64)), pa.array(above[:, 0] >= reject)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def severities(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """Expected severity, chance of any toxicity, grade and verdict for every row of (doc_id, text).

    Null and empty texts hold no feature and get the score of that. Null and repeated ids are
    kept as they are; an empty table gives no rows; without toxic or without other labelled
    texts no feature is kept and no document is rejected. Other columns are not looked at.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model, reject), SCHEMA)


def _keep(model: Model, reject: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            yield rows.filter(pa.array(model.above(data, offsets)[:, 0] < reject))

    return run


def drop_toxic(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows, with all their columns, that `severities` does not call toxic."""
    return documents.mapInArrow(_keep(model, reject), documents.schema)

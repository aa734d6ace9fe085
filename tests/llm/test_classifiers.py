import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paddock.llm import common, compression, language, toxicity

FOLDER = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    return [common.read(spark, FOLDER, t) for t in ("documents", "labels")]


# --- toxicity


def test_toxicity_of_held_out_documents(tables):
    documents, labels = tables
    model = toxicity.train(documents, labels)
    assert (np.diff(model.thresholds) > 0).all()
    truth = {r.doc_id: r.toxic for r in labels.collect() if held_out(r.doc_id)}
    got = [(truth[r.doc_id], r) for r in toxicity.severities(documents, model).collect() if r.doc_id in truth]
    assert sum(y == r.toxic for y, r in got) / len(got) > 0.93
    assert all(0 <= r.severity <= toxicity.GRADES and 0 <= r.grade <= toxicity.GRADES for _, r in got)


def test_severity_follows_the_grades():
    clean = ["the field is green and the river runs quick"] * 80
    toxic = [" ".join(["the field"] * 5 + ["idiot"] * n) for n in (1, 3, 9) for _ in range(30)]
    model = toxicity.fit(clean + toxic, np.array([0] * 80 + [1] * 90))
    texts = ["the river runs", "the idiot", "idiot idiot idiot", "idiot " * 12]
    data, offsets = toxicity._pack(texts)
    severity = model.above(data, offsets).sum(axis=1)
    assert (np.diff(severity) > 0).all() and severity[0] < 0.5 < severity[1]


def test_toxicity_rows(documents, edges, one_each, tables):
    model = toxicity.fit(["good day", "idiot here"] * 60, np.array([0, 1] * 60))
    rows = edges + [(1, "IDIOT HERE", "en", "s", 0), (2, "good", "en", "s", 0)]
    got = toxicity.severities(documents(rows), model)
    one_each(rows, got)
    assert {r.doc_id for r in got.where("toxic").collect()} == {1}
    kept = toxicity.drop_toxic(documents(rows), model)
    assert kept.schema == documents(rows).schema and kept.count() == len(rows) - 1
    assert toxicity.severities(documents([]), model).count() == 0


def test_no_labels_reject_nothing(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(1, "idiot", "en", "s", 0)]
    assert toxicity.drop_toxic(documents(rows), toxicity.train(documents(rows), labels)).count() == 1
    some = spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(documents(rows), toxicity.train(documents(rows), some)).count() == 1


# --- language


def test_language_of_held_out_documents(tables):
    documents, _ = tables
    model = language.train(documents)
    assert sorted(n for v in model.within.values() for n in v.names) == ["de", "en", "es", "fr"] and len(model.within) == 2
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = [r for r in language.identify(documents, model).collect() if r.held_out]
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.96


def test_language_rows(documents, edges, one_each):
    model = language.fit(["the field is green", "la mesa es verde"] * 5, ["en", "es"] * 5)
    rows = edges + [(1, "the green field", None, "s", 0), (2, "漢字", None, "s", 0)]
    got = language.identify(documents(rows), model)
    one_each(rows, got)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].lang_pred == "en" and by_id[2].lang_pred != "und"
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902, 905))
    assert language.identify(documents([]), model).count() == 0


def test_no_languages(documents):
    rows = [(i, "some text", None, "s", 0) for i in range(5)]
    got = language.identify(documents(rows), language.train(documents(rows))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = [(i, "some text", "en", "s", 0) for i in range(9)]
    assert {r.lang_pred for r in language.identify(documents(one), language.train(documents(one))).collect()} == {"en"}


# --- quality


def test_quality_of_held_out_documents(tables):
    documents, labels = tables
    got = {r.doc_id: r for r in compression.quality(documents, compression.train(documents, labels)).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if held_out(r.doc_id)}
    assert all(got[i].held_out and got[i].predicted == (got[i].score >= 0.7) and 0 <= got[i].score <= 1 for i in truth)
    good, bad = ([got[i].score for i, y in truth.items() if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.92


def test_quality_rows(documents, edges, one_each):
    model = compression.fit(["a good and plain sentence about the river"] * 30 + ["BUY!! NOW!! CLICK!! HERE!!"] * 30, np.array([1] * 30 + [0] * 30))
    rows = edges + [(1, "a plain sentence about the good river", "en", "s", 0), (2, "CLICK!! NOW!! BUY!!", "en", "s", 0)]
    got = compression.quality(documents(rows), model)
    one_each(rows, got)
    by_id = {r.doc_id: r.score for r in got.collect()}
    assert by_id[1] > by_id[2] and by_id[900] == by_id[901]
    assert compression.quality(documents([]), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (None, 1, 0), (2, None, None)], [(i, 1, 0) for i in range(9)]])
def test_quality_with_few_labels(spark, documents, labels):
    rows = [(i, "some text", "en", "s", 0) for i in range(10)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = compression.quality(documents(rows), compression.train(documents(rows), table)).collect()
    assert len(got) == 10 and len({r.score for r in got}) == 1


def test_scoring_holds_little_at_a_time():
    texts = pa.array(["some words of a common line " * 80] * 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"])
    model = toxicity.Model(np.arange(1, 801, dtype=np.uint64), np.ones(800), np.array([1.0, 2.0, 3.0]))
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in toxicity._keep(model, 0.5)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == len(texts)
    assert peak < 60 << 20

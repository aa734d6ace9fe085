import random

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from llm.test_decontaminate import by_hand as items_by_hand
from llm.test_minmax import by_hand as groups_by_hand
from paddock.llm import queries
from registry.queries import TABLES
from tools.check_oracles import compare

FOLDER = "/root/testdata/sf0.001"
OPS = "op1_suffixes op2_packing op3_personal_data op4_decontamination op5_compression op6_chat op7_toxicity op8_language op9_near_vectors op10_min_max op11_automata op12_structure op13_collocations".split()


def test_registered():
    assert set(OPS) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OPS)
def test_query_equals_its_sql_twin_or_has_all_rows(spark, connection, name):
    verdict = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert verdict.startswith(("ok", "rows only")), verdict


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_stages_decide_as_brute_force_does(spark, documents, sentence, tmp_path):
    rng = random.Random(12)
    items = [(i, sentence(rng, 25)) for i in range(5)]
    rows = [(i, sentence(rng, rng.randint(30, 90)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(20)]
    rows += [(200 + i, sentence(rng, 20) + " " + rng.choice(items)[1], "en", "s", 0) for i in range(15)]
    rows += [(300 + i, sentence(rng, 30) + f" idiot mail a{i}@b.org idiot", "en", "s", 0) for i in range(15)]
    rows += [(400 + i, sentence(rng, 30) + f" mail a{i}@b.org", "en", "s", 0) for i in range(5)] + [(None, "no id at all", "en", "s", 0), (500, None, "en", "s", 0), (501, None, "en", "s", 0)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i is not None and 300 <= i < 400)) for i, *_ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows)

    def run(name, df):
        out = stage(name)(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = run("toxicity", docs)
    assert clean.columns == docs.columns and ids(clean) == sorted([r[0] for r in rows if r[0] is None or not 300 <= r[0] < 400], key=repr)
    single = run("near_duplicates", clean)
    left = [r for r in rows if r[0] is None or not 300 <= r[0] < 400]
    kept = {g[0] for g in groups_by_hand(left) if g[3]} | {None}
    assert single.columns == docs.columns and ids(single) == sorted(kept, key=repr)
    left = [r for r in left if r[0] in kept]
    pure = run("decontamination", single)
    bad = {d for d, _ in items_by_hand([(r[0], r[1]) for r in left], items)}
    left = [r for r in left if r[0] not in bad]
    assert pure.columns == docs.columns and ids(pure) == sorted([r[0] for r in left], key=repr)
    masked = run("personal_data", pure)
    assert masked.columns == docs.columns and ids(masked) == ids(pure)
    texts = {r.doc_id: r for r in masked.collect()}
    assert all("[EMAIL]" in texts[i].text and "@" not in texts[i].text and texts[i].n_chars == len(texts[i].text) for i in range(400, 405))
    packed = run("packing", masked)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in left}
    assert packed.where("start = 0").count() == len(left) and public_tokenizers.path(queries.TOKENIZER)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edges_and_empty_tables(spark, documents, edges, name):
    for rows in (edges, []):
        out = stage(name)(spark, documents(rows), FOLDER)
        got = out.collect()
        assert name == "packing" or out.columns == documents([]).columns
        if name == "near_duplicates":
            assert len(got) == len(rows) - (2 if rows else 0)  # one of two equal texts, one of two equal rows
        elif name != "packing":
            assert len(got) == len(rows)


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert got and all(0 < r.length <= 1024 for r in got)

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from paddock.operators import timeline


def history(seed=3, keys="abc", n=400):
    """Key ``a`` holds most rows, in bursts, with equal days and gaps."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "a" if rng.random() < 0.7 else rng.choice(keys)
        out.append((k, date(2025, 1, 1) + timedelta(days=rng.choice([rng.randrange(30), rng.randrange(300)])), i, rng.randrange(1, 5000) / 100))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, d date, seq int, v double")


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_trailing_mean_equals_brute_force(spark, parts):
    data = history()
    out = timeline.trailing_mean(frame(spark, data), ["k"], ["d", "seq"], "v", rows=14, scale=2, partitions=parts)
    assert out.columns == ["k", "d", "seq", "v", "trailing_avg"]
    got = {r["seq"]: r["trailing_avg"] for r in out.collect()}
    assert len(got) == len(data)
    for k in "abc":
        line = sorted(x for x in data if x[0] == k)
        line.sort(key=lambda x: (x[1], x[2]))
        for i, x in enumerate(line):
            before = [y[3] for y in line[max(0, i - 14) : i]]
            assert got[x[2]] == (pytest.approx(sum(before) / len(before)) if before else None)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_running_total_equals_brute_force(spark, parts):
    data = history(seed=8)
    out = timeline.running_total(frame(spark, data), ["k"], ["d", "seq"], "v", scale=2, partitions=parts)
    got = {r["seq"]: r["running_total"] for r in out.collect()}
    assert len(got) == len(data)
    for k in "abc":
        total = 0.0
        for x in sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2])):
            total += x[3]
            assert got[x[2]] == pytest.approx(total)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "bigint", "double"])
def test_chunks_follow_the_ordering(spark, kind):
    column = {
        "date": F.date_add(F.lit(date(2024, 2, 20)), F.col("id").cast("int")),
        "timestamp": F.timestamp_seconds(F.col("id") * 7000),
        "timestamp_ntz": F.timestamp_seconds(F.col("id") * 7000).cast("timestamp_ntz"),
        "bigint": F.col("id") * 1000,
        "double": F.col("id") / 3,
    }[kind]
    df = spark.range(200).select(F.lit("a").alias("k"), column.alias("t"))
    chunked = timeline.ranges(df, ["k"], ["t"], 12)
    rows = sorted(((r["t"], r[timeline.CHUNK]) for r in chunked.collect()), key=lambda r: r[0])
    chunks = [c for _, c in rows]
    assert chunks == sorted(chunks) and len(set(chunks)) >= 5


@pytest.mark.parametrize("crowd", ["near", "equal"])
def test_crowded_values_are_cut_again(spark, crowd):
    """Most rows in a sliver of the range, or equal in the first ordering column."""
    t = F.col("id") / 1e9 if crowd == "near" else F.lit(0.0)
    df = spark.range(400).select(F.lit("a").alias("k"), F.when(F.col("id") == 399, 1e6).otherwise(t).alias("t"), "id")
    chunked = timeline.ranges(df, ["k"], ["t", "id"], 8)
    sizes = [r["count"] for r in chunked.groupBy(timeline.CHUNK).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 400
    line = [r[timeline.CHUNK] for r in chunked.orderBy("t", "id").collect()]
    assert line == sorted(line)


def test_rows_without_order_value_come_first(spark):
    df = spark.createDataFrame([("a", None, 100, 1.0)] + [("a", i, i, 1.0) for i in range(50)], "k string, d int, seq int, v double")
    out = timeline.running_total(df, ["k"], ["d", "seq"], "v", scale=0, partitions=10)
    got = {r["seq"]: r["running_total"] for r in out.collect()}
    assert got[100] == 1.0 and got[0] == 2.0 and got[49] == 51.0


def test_missing_values_beside_one_value_are_told_apart(spark):
    data = [("a", None if i % 2 else 7, i, 1.0) for i in range(100)]
    df = spark.createDataFrame(data, "k string, d int, seq int, v double")
    out = timeline.running_total(df, ["k"], ["d", "seq"], "v", scale=0, partitions=10)
    got = {r["seq"]: r["running_total"] for r in out.collect()}
    assert [got[i] for i in range(1, 100, 2)] == [float(n) for n in range(1, 51)]
    assert [got[i] for i in range(0, 100, 2)] == [float(n) for n in range(51, 101)]


def test_a_key_with_texts_as_ordering_is_split(spark):
    data = [("a", f"n{99 - i:02d}", i, 1.0) for i in range(100)]
    df = spark.createDataFrame(data, "k string, name string, seq int, v double")
    assert timeline.ranges(df, ["k"], ["name"], 10).select(timeline.CHUNK).distinct().count() >= 5
    out = timeline.running_total(df, ["k"], ["name", "seq"], "v", scale=0, partitions=10)
    assert {r["seq"]: r["running_total"] for r in out.collect()} == {i: 100.0 - i for i in range(100)}


def test_running_totals_have_the_same_digits_for_any_ranges(spark):
    rng = random.Random(4)
    data = [("a", i, i, rng.randrange(10**9) / 1000) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, d int, seq int, v double")
    results = [
        sorted((r["seq"], r["running_total"]) for r in timeline.running_total(df, ["k"], ["d"], "v", scale=3, partitions=n).collect())
        for n in (1, 7, 40)
    ]
    assert results[0] == results[1] == results[2]


def test_drop_alerts(spark):
    data = [("a", date(2025, 1, 1) + timedelta(days=2 * i), i, v) for i, v in enumerate([100.0, 100.0, 84.0, 90.0])]
    zero = [("z", date(2025, 1, 1) + timedelta(days=i), 10 + i, v) for i, v in enumerate([0.0, -1.0])]
    out = timeline.drop_alerts(frame(spark, data + zero), ["k"], ["d"], "v")
    hits = {r["seq"]: (r["trailing_avg"], round(r["drop_pct"], 6)) for r in out.collect()}
    assert hits == {2: (100.0, 16.0)}
    unguarded = timeline.drop_alerts(frame(spark, data + zero), ["k"], ["d"], "v", positive_only=False)
    assert {r["seq"]: r["drop_pct"] for r in unguarded.collect()}[11] is None


@pytest.mark.parametrize("parts", [1, 7])
def test_global_rank_numbers_every_row_once(spark, parts):
    df = spark.createDataFrame([(i, float(i * 7919 % 101)) for i in range(500)], "id int, score double")
    out = timeline.global_rank(df, [F.desc("score"), F.asc("id")], partitions=parts)
    got = [(r["rank"], -r["score"], r["id"]) for r in out.collect()]
    assert sorted(r[0] for r in got) == list(range(1, 501))
    assert [r[1:] for r in sorted(got)] == sorted(r[1:] for r in got)


def test_top_per_key_limits_before_the_shuffle(spark):
    df = frame(spark, history())
    top = timeline.top_per_key(df, ["k"], [F.desc("d"), F.desc("seq")], 2)
    assert plan_of(top).count("WindowGroupLimit") == 2
    assert len(top.collect()) == 6


def test_latest_rows_are_returned_oldest_first(spark):
    df = spark.range(10).select(F.col("id").alias("t"))
    out = timeline.latest_rows(df, ["t"], 3)
    assert [r["t"] for r in out.collect()] == [7, 8, 9]
    assert "TakeOrderedAndProject" in plan_of(df.orderBy(F.desc("t")).limit(3))


def test_best_claim(spark):
    df = spark.createDataFrame([("x", "T", 0.7, 0), ("y", "T", 0.9, 1), ("z", "T", 0.9, 2), ("n", None, 0.1, 3)], "c string, t string, s double, p int")
    out = timeline.best_claim(df, "t", [F.desc("s"), F.asc("p")])
    assert {r["c"]: r["is_winner"] for r in out.collect()} == {"x": False, "y": True, "z": False, "n": False}


def test_timestamps_within_one_second_are_kept_in_order(spark):
    base = datetime(2025, 1, 1)
    data = [("a", base + timedelta(microseconds=i % 5, seconds=i // 20), i, 1.0) for i in range(200)]
    df = spark.createDataFrame(data, "k string, ts timestamp, seq int, v double")
    out = timeline.running_total(df, ["k"], ["ts", "seq"], "v", scale=0, partitions=15)
    order = sorted(data, key=lambda x: (x[1], x[2]))
    got = {r["seq"]: r["running_total"] for r in out.collect()}
    assert [got[x[2]] for x in order] == [float(i + 1) for i in range(200)]

import random
from datetime import date, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from paddock.operators import joins

DAY0 = date(2025, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def frames(spark, left, right, by=False):
    keys = "k string, " if by else ""
    return (
        spark.createDataFrame([(i, *(l[:-1]), day(l[-1])) for i, l in enumerate(left)], f"id int, {keys} d date"),
        spark.createDataFrame([(*r[:-2], day(r[-2]), r[-1]) for r in right], f"{keys} rd date, v double"),
    )


def asof(spark, left, right, tolerance=5, by=False):
    l, r = frames(spark, left, right, by)
    out = joins.asof_nearest(
        l, r, "d", "rd", ["v"], by=["k"] if by else [], tolerance_days=tolerance, matched_date="md", offset="off"
    )
    return {x["id"]: (x["v"], x["md"], x["off"]) for x in out.collect()}


def test_asof_tie_takes_the_earlier_date(spark):
    assert asof(spark, [(10,)], [(8, 1.0), (12, 2.0)])[0] == (1.0, day(8), 2)


def test_asof_tolerance_is_inclusive(spark):
    got = asof(spark, [(10,), (11,), (4,)], [(5, 1.0)])
    assert got == {0: (1.0, day(5), 5), 1: (None, None, None), 2: (1.0, day(5), 1)}


def test_asof_keeps_null_values_and_skips_null_dates(spark):
    got = asof(spark, [(10,), (None,)], [(10, None), (9, 3.0), (None, 9.0)])
    assert got == {0: (None, day(10), 0), 1: (None, None, None)}


def test_asof_duplicate_right_dates_do_not_multiply_rows(spark):
    assert asof(spark, [(10,)], [(9, 5.0), (9, 4.0)]) == {0: (4.0, day(9), 1)}


def test_asof_by_key_ignores_null_keys(spark):
    got = asof(spark, [("a", 10), (None, 10), ("c", 10)], [("a", 11, 1.0), (None, 10, 2.0), ("b", 10, 3.0)], by=True)
    assert got == {0: (1.0, day(11), 1), 1: (None, None, None), 2: (None, None, None)}


def test_asof_right_order_picks_whole_rows(spark):
    left = spark.createDataFrame([(1, DAY0)], "id int, d date")
    right = spark.createDataFrame([(DAY0, 2, 5.0, None), (DAY0, 1, None, 7.0)], "rd date, seq int, a double, b double")
    out = joins.asof_nearest(left, right, "d", "rd", ["a", "b"], right_order=["seq"])
    assert tuple(out.select("a", "b").first()) == (None, 7.0)


@pytest.mark.parametrize("seed", range(3))
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    tolerance = rng.choice([0, 1, 3, 5])
    left = [(rng.choice("ab"), rng.randrange(-40, 80)) for _ in range(150)]
    right = [(rng.choice("abc"), rng.randrange(-40, 80), float(rng.randrange(100))) for _ in range(60)]
    got = asof(spark, left, right, tolerance, by=True)
    for i, (k, d) in enumerate(left):
        near = sorted((abs(d - rd), rd, v) for rk, rd, v in right if rk == k and abs(d - rd) <= tolerance)
        assert got[i] == ((near[0][2], day(near[0][1]), near[0][0]) if near else (None, None, None))


def span_stats(spark, spans, readings, **options):
    s = spark.createDataFrame([(i, k, day(lo), day(hi)) for i, (k, lo, hi) in enumerate(spans)], "id int, k string, lo date, hi date")
    r = spark.createDataFrame([(k, day(d), v) for k, d, v in readings], "k string, d date, v double")
    stats = {
        "n": ("count", F.lit(1)),
        "avg": ("avg", F.col("v")),
        "total": ("sum", F.col("v")),
        "low": ("min", F.col("v")),
        "top": ("max", F.col("v")),
        "cold": ("count_if", F.col("v") < 40),
    }
    out = joins.range_stats(s, r, "lo", "hi", "d", stats, **{"by": ["k"], **options})
    return {x["id"]: tuple(x[c] for c in ("n", "avg", "total", "low", "top", "cold")) for x in out.collect()}


def test_range_bounds_are_inclusive_and_empty_spans_keep_zero_counts(spark):
    got = span_stats(
        spark,
        [("a", 5, 7), ("a", 8, 9), ("a", 5, None), ("a", 9, 5), ("b", 5, 7)],
        [("a", 5, 30.0), ("a", 7, 50.0), ("a", 7, None), ("a", 4, 1.0), ("a", 10, 1.0)],
    )
    assert got[0] == (3, 40.0, 80.0, 30.0, 50.0, 1)
    assert all(got[i] == (0, None, None, None, None, 0) for i in (1, 2, 3, 4))


def test_range_inner_drops_empty_spans(spark):
    assert set(span_stats(spark, [("a", 5, 7), ("b", 5, 7)], [("a", 5, 1.0)], how="inner")) == {0}


@pytest.mark.parametrize("keyed", [True, False])
def test_range_stats_equal_brute_force(spark, keyed):
    rng = random.Random(11)
    spans = [(rng.choice("ab"), lo := rng.randrange(0, 90), lo + rng.randrange(0, 60)) for _ in range(60)]
    readings = [(rng.choice("ab"), rng.randrange(0, 150), float(rng.randrange(100))) for _ in range(400)]
    got = span_stats(spark, spans, readings, by=["k"] if keyed else [])
    for i, (k, lo, hi) in enumerate(spans):
        v = [x for rk, d, x in readings if lo <= d <= hi and (rk == k or not keyed)]
        want = (len(v), sum(v) / len(v), sum(v), min(v), max(v), sum(x < 40 for x in v)) if v else (0, None, None, None, None, 0)
        assert got[i] == pytest.approx(want) if v else got[i] == want


def test_range_names_are_sorted_and_distinct(spark):
    s = spark.createDataFrame([(day(0), day(9))], "lo date, hi date")
    r = spark.createDataFrame([(day(1), "b"), (day(2), "a"), (day(2), "b")], "d date, farm string")
    out = joins.range_stats(s, r, "lo", "hi", "d", {"farms": ("names", F.col("farm"))})
    assert out.first()["farms"] == "a, b"


def test_long_spans_take_two_rows_each(spark):
    """Counts and sums of spans of decades: no plan node has more rows than a few for each span or day."""
    s = spark.range(200).select(F.expr("date_add(date'1989-01-01', cast(id AS int))").alias("lo"), F.expr("date_add(date'2020-01-01', cast(id * 7 AS int))").alias("hi"))
    r = spark.range(11000).select(F.expr("date_add(date'1990-06-01', cast(id AS int))").alias("d"), F.col("id").cast("double").alias("v"))
    out = joins.range_stats(s, r, "lo", "hi", "d", {"n": ("count", F.lit(1)), "sum": ("sum", F.col("v"), 0)})
    got = {(x["n"], x["sum"]) for x in out.collect()}
    assert max(n for n, _ in got) > 10000 and all(total == n * (n - 1) / 2 for n, total in got)
    nodes, most = [out._jdf.queryExecution().executedPlan()], 0
    plan = nodes[0].executedPlan() if "Adaptive" in nodes[0].nodeName() else nodes[0]
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        inner = node.children()
        nodes += [inner.apply(i) for i in range(inner.size())]
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 200 <= most <= 800


def test_very_many_names(spark):
    s = spark.createDataFrame([(day(0), day(300)), (day(5), day(6))], "lo date, hi date")
    r = spark.range(100_000).select(F.expr("date_add(date'2025-01-01', cast(id % 200 AS int))").alias("d"), F.concat(F.lit("farm "), F.col("id")).alias("farm"))
    got = sorted(len(x["farms"].split(", ")) for x in joins.range_stats(s, r, "lo", "hi", "d", {"farms": ("names", F.col("farm"))}).collect())
    assert got == [1000, 100_000]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_nearest_value_equals_brute_force(spark, parts):
    rng = random.Random(5)
    spot = lambda: rng.choice([rng.randrange(0, 400) / 4, 50 + rng.randrange(0, 64) / 1024])
    left = [(i, rng.choice("abz"), spot()) for i in range(160)]
    right = [(i, rng.choice("ab"), spot()) for i in range(30)]
    l = spark.createDataFrame(left, "id int, g string, x double")
    r = spark.createDataFrame(right, "rid int, g string, y double")
    out = joins.nearest_value(l, r, "x", "y", ["rid"], by=["g"], key="rid", partitions=parts)
    got = {o["id"]: (o["rid"], o["price_diff"]) for o in out.collect()}
    want = {}
    for i, g, x in left:
        near = sorted((abs(x - y), j) for j, h, y in right if h == g)
        if near:
            want[i] = (near[0][1], near[0][0])
    assert got == want


def test_left_join_suffixes_only_colliding_columns(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, notes string, head int")
    b = spark.createDataFrame([(1, "y", 7)], "id int, notes string, price int")
    assert joins.left_join_suffixed(a, b, ["id"], "_hedge").columns == ["id", "notes", "head", "notes_hedge", "price"]


def test_latest_row_is_taken_whole_and_null_keys_are_left_out(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), (None, 9, 9)], "k string, t int, v int")
    assert rows(joins.latest_by_key(df, ["k"], ["t"], {"v": F.col("v")})) == [("a", None)]
    assert rows(joins.first_by_key(df, ["k"], ["t"], {"v": F.col("v")})) == [("a", 5)]


def test_key_checks(spark, rows):
    parent = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    child = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "k string")
    other = spark.createDataFrame([("x",)], "k string")
    assert rows(joins.orphan_keys(child, parent, "k")) == [("c",)]
    assert rows(joins.shared_keys(child, parent, "k")) == [("b",)]
    assert rows(joins.key_overlap(parent, {"child": child, "other": other}, "k")) == [("child", 1, 1), ("other", 1, 0)]


def test_scalars_and_pairs_without_joins(spark, rows):
    df = spark.createDataFrame([(1, 10.0), (2, 30.0)], "id int, v double")
    scaled = joins.with_scalars(df, low=df.agg(F.min("v")))
    assert rows(scaled) == [(1, 10.0, 10.0), (2, 30.0, 10.0)]
    ranking = spark.range(9).select((9 - F.col("id")).alias("rank"))
    paired = joins.pair_with(df.select("id"), ranking, ["rank"], 2)
    assert rows(paired.select("id", "choice.rank")) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for plan in (plan_of(scaled), plan_of(paired)):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_period_benchmark_reports_months_without_data(spark, rows):
    positions = spark.createDataFrame([(1, 2025, 1), (2, 2025, 2), (3, None, None)], "id int, y int, m int")
    facts = spark.createDataFrame([(day(0), 10.0), (day(5), 20.0), (None, 99.0)], "d date, price double")
    out = joins.period_benchmark(positions, facts, F.col("y"), F.col("m"), "d", {"avg": "price"}, has_data="has")
    assert rows(out, "id", "avg", "has") == [(1, 15.0, True), (2, None, False), (3, None, False)]


def test_month_offset_stops_at_december(spark, rows):
    df = spark.createDataFrame([(1, date(2025, 1, 9)), (2, date(2025, 11, 9)), (3, date(2025, 3, 1))], "id int, d date")
    index = spark.createDataFrame([(1, 10.0), (3, 14.0), (11, 2.0), (12, 3.6)], "m int, level double")
    out = joins.month_offset_lookup(df, index, "d", "m", "level")
    got = {r["id"]: (r["start_level"], r["end_level"], r["risk"]) for r in out.collect()}
    assert got == {1: (10.0, 14.0, "HIGH"), 2: (2.0, 3.6, "MODERATE"), 3: (14.0, None, None)}


def test_no_nested_loops_in_any_registered_plan(spark):
    from registry.queries import QUERIES

    for name in ("q_asof_nearest", "q_asof_keyed", "q_interval_stats", "q_range_window", "q_range_global", "q_nearest_value", "q_scenario_rows"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_days_are_asked_for(spark):
    instants = spark.sql("SELECT timestamp'2025-01-01 10:00:00' AS t, 1 AS v")
    days = spark.sql("SELECT date'2025-01-01' AS d")
    with pytest.raises(TypeError, match="must be a date"):
        joins.asof_nearest(days, instants, "d", "t", ["v"])


def test_too_many_tables_are_refused(spark):
    with pytest.raises(ValueError, match="62"):
        joins.key_overlap(spark.range(1), {str(i): spark.range(1) for i in range(63)}, "id")

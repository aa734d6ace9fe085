from datetime import date

from pyspark.sql import functions as F

from paddock.operators import cleaning
from paddock.operators.cleaning import CleaningSpec, clean, generic_spec
from paddock.plans import cleanup


def test_null_threshold_is_strict(spark):
    df = spark.range(10).select(
        "id",
        F.when(F.col("id") < 1, "x").alias("nine_null"),
        F.lit(None).cast("string").alias("all_null"),
    )
    kept, gone = cleaning.drop_mostly_null(df)
    assert (kept.columns, gone) == (["id", "nine_null"], ["all_null"])


def test_constant_columns_ignore_nulls_and_keep_the_protected(spark):
    df = spark.range(4).select(
        "id",
        F.lit("c").alias("constant"),
        F.when(F.col("id") > 1, 7).alias("constant_with_nulls"),
        F.lit(None).cast("int").alias("empty"),
        F.lit("k").alias("report_date"),
        (F.col("id") > 1).alias("flag"),
    )
    kept, gone = cleaning.drop_constant(df, keep=["report_date"])
    assert kept.columns == ["id", "report_date", "flag"]
    assert gone == ["constant", "constant_with_nulls", "empty"]


def test_column_decisions_take_one_action(spark):
    df = spark.range(3).select("id", F.lit(1).alias("one"))
    nulls, same = cleaning.null_and_constant_columns(df)
    assert nulls == {"id": 0.0, "one": 0.0} and same == {"one"}


def test_spec_steps(spark):
    df = spark.createDataFrame(
        [
            (" HE ", "1/16/2025", "1,234", "-0.0008", "Cow", None, "a", "20250116"),
            ("ZC", "junk", "n.a.", "0.5", None, None, "b", "99999999"),
            ("XX", "1/2/2025", "7", None, "Steer", None, "c", "20250102"),
        ],
        "Commodity string, tradeDay string, Est string, Rank string, Type string, void string, `Index` string, Eff string",
    )
    spec = CleaningSpec(
        dates=("tradeDay",),
        compact_dates=("Eff",),
        comma_numbers=("Est",),
        numbers=("Rank",),
        value_maps={"price_unit": ("Commodity", {"ZC": "cents/bushel"})},
        flags={"is_cow": lambda: F.col("Type") == "Cow"},
        drop=("Index", "Missing"),
        drop_mostly_null=True,
        rename={"Est": "estimate"},
        clip={"Rank": (0.0, 1.0)},
        sort=("trade_day",),
    )
    out = clean(df, spec)
    assert out.dropped == ["Index", "void"]
    assert out.table.columns == ["commodity", "trade_day", "estimate", "rank", "type", "eff", "price_unit", "is_cow"]
    assert [tuple(r) for r in out.table.collect()] == [
        ("XX", date(2025, 1, 2), 7.0, None, "Steer", date(2025, 1, 2), None, False),
        ("HE", date(2025, 1, 16), 1234.0, 0.0, "Cow", date(2025, 1, 16), None, True),
        ("ZC", None, None, 0.5, None, None, "cents/bushel", False),
    ]


def test_required_columns_drop_rows_before_and_after_parsing(spark):
    df = spark.createDataFrame([("1/2/2025",), (None,), ("junk",)], "tradingDay string")
    out = clean(df, CleaningSpec(require=("tradingDay",), dates=("tradingDay",)))
    assert [r[0] for r in out.table.collect()] == [date(2025, 1, 2)]


def test_generic_spec_sorts_by_the_first_date_present(spark):
    df = spark.createDataFrame([("b", "1/2/2025"), ("a", "1/1/2025"), ("n", None)], "Name string, report_end_date string")
    spec = generic_spec(["report_date", "report_end_date"], df.columns)
    assert [r["name"] for r in clean(df, spec).table.collect()] == ["a", "b", "n"]


def test_sort_spreads_equal_dates(spark):
    df = spark.range(1000).select(F.lit(date(2025, 1, 1)).alias("d"), "id")
    out = cleaning.sort_rows(df.repartition(4), ["d"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = out.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert filled > 1


def test_clip_counts(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "x double")
    assert tuple(cleaning.count_outside(df, "x", 0, 1).first()) == (1, 1)


def test_unknown_producer_tables_only_get_new_names(spark):
    df = spark.createDataFrame([("x", "x")], "`Some Name` string, other string")
    assert cleanup.clean_producer(df, "unknown").table.columns == ["some_name", "other"]


def test_futures_numbers(spark):
    df = spark.createDataFrame([("HEM25", "2025-01-03", "1", "x"), ("HEM25", "2025-01-02", "2", "5")], "Symbol string, Time string, Open string, `Open Interest` string")
    out = cleanup.clean_futures(df).table
    assert [tuple(r) for r in out.collect()] == [("HEM25", date(2025, 1, 2), 2.0, 5.0), ("HEM25", date(2025, 1, 3), 1.0, None)]


def test_lean_specs_run_on_their_columns(spark):
    quotes = spark.createDataFrame(
        [("20250116", "1/1/2025", "-3", "[List]", "q"), ("20250117", "1/2/2025", "4", "[List]", "r"), ("20250118", "x", None, "[List]", "s")],
        "salesEffectiveDate string, `Expiration Date` string, `Weekdays to Expiration` string, errorMessages string, name string",
    )
    out = cleanup.clean_market(quotes, "LRP Quotes").table
    assert out.columns == ["sales_effective_date", "expiration_date", "weekdays_to_expiration", "name", "is_expired"]
    assert [r["is_expired"] for r in out.orderBy("name").collect()] == [True, False, False]
    index = spark.createDataFrame([("1/1/2025", "1", "2", "3", "4", "9")], "report_date string, LBS string, `$` string, `LBS.1` string, `$.1` string, Index string")
    assert cleanup.clean_market(index, "Indexes").table.columns == ["report_date", "lbs_day1", "usd_day1", "lbs_day2", "usd_day2"]

from datetime import date

import pytest
from pyspark.sql import functions as F

from paddock.functions import market as M
from paddock.functions import numeric as N
from paddock.functions import text as X
from paddock.functions.dates import (
    contract_is_unlisted,
    contract_month,
    contract_symbol,
    contract_year,
    contract_yyyymm,
    parse_date,
    parse_yyyymmdd,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("Symbol.1", "symbol1"),
        ("Power_Usage_kWh", "power_usage_k_wh"),
        (" Net Payment-$ ", "net_payment_usd"),
        ("Weekdays to Expiration", "weekdays_to_expiration"),
        ("weekofYear", "weekof_year"),
        ("Head #", "head_num"),
        ("A/B\\C", "a_b_c"),
        ("__x__y__", "x_y"),
    ],
)
def test_snake_name(name, expected):
    assert X.snake_name(name) == expected


def test_snake_columns_refuses_collisions(spark):
    with pytest.raises(ValueError, match="collide"):
        X.snake_columns(spark.createDataFrame([(1, 2)], ["A B", "a_b"]))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1/16/2025", date(2025, 1, 16)),
        ("16/1/2025", date(2025, 1, 16)),
        ("1-16-2025", date(2025, 1, 16)),
        ("1/16/25", date(2025, 1, 16)),
        ("2010-01-02 00:00:00.000", date(2010, 1, 2)),
        ("\t2010-01-02 ", date(2010, 1, 2)),
        ("2010-01-02T10:30:00Z", date(2010, 1, 2)),
        ("2025/1/6", date(2025, 1, 6)),
        ("20250116", date(2025, 1, 16)),
        ("Jan 5, 2025", date(2025, 1, 5)),
        ("January 5, 2025", date(2025, 1, 5)),
        ("5-Jan-2025", date(2025, 1, 5)),
        ("2/31/2025", None),
        ("2025-13-01", None),
        ("2025-01-02 later", None),
        ("junk", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    assert one(spark, parse_date(F.lit(text).cast("string"))) == expected


def test_parse_yyyymmdd(spark):
    assert one(spark, parse_yyyymmdd(F.lit(20250116))) == date(2025, 1, 16)
    assert one(spark, parse_yyyymmdd(F.lit(99999999))) is None
    assert one(spark, parse_yyyymmdd(F.lit(2025))) is None


def test_numbers_in_texts(spark):
    assert one(spark, X.comma_number(F.lit("1,234.5"))) == 1234.5
    assert one(spark, X.comma_number(F.lit("n.a."))) is None
    assert one(spark, X.to_number(F.lit("5d"))) is None
    assert one(spark, X.to_number(F.lit(" -1.5e2 "))) == -150.0
    assert one(spark, X.strip(F.lit("   0 - 35% Choice\n"))) == "0 - 35% Choice"


@pytest.mark.parametrize(
    ("month", "symbol", "unlisted", "yyyymm"),
    [
        ("25-Jun", "HEM25", False, 202506),
        ("26-Jan", "HEG26", True, 202601),
        ("25-Mar", "HEJ25", True, 202503),
        ("25-Sep", "HEV25", True, 202509),
        ("25-Nov", "HEZ25", True, 202511),
        ("25-Foo", "HE?25", True, 202501),
    ],
)
def test_contract_months(spark, month, symbol, unlisted, yyyymm):
    c = F.lit(month)
    got = spark.range(1).select(contract_symbol(c), contract_is_unlisted(c), contract_yyyymm(c)).first()
    assert tuple(got) == (symbol, unlisted, yyyymm)


def test_contract_period_is_null_for_unknown_months(spark):
    got = spark.range(1).select(contract_year(F.lit("26-Jan")), contract_month(F.lit("26-Jan")), contract_month(F.lit("26-X")))
    assert tuple(got.first()) == (2026, 1, None)


def test_round_even_takes_ties_to_even(spark):
    values = [(0.5, 0, 0.0), (1.5, 0, 2.0), (0.25, 1, 0.2), (0.35, 1, 0.4), (-0.25, 1, -0.2), (3.369803, 1, 3.4)]
    for value, digits, expected in values:
        assert one(spark, N.round_even(F.lit(value), digits)) == expected


def test_clip_and_flag_with_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, N.clip(F.lit(-0.0008), 0.0, 1.0)) == 0.0
    assert one(spark, N.clip(F.lit(7.0), 0.0, 1.0)) == 1.0
    assert one(spark, N.clip(null, 0.0, 1.0)) is None
    assert one(spark, N.flag(null < 40)) is False
    assert one(spark, N.ratio(F.lit(1.0), F.lit(0.0))) is None


def test_exact_sums_do_not_depend_on_order(spark):
    df = spark.range(1000).select((F.col("id") / 10).alias("x"))
    shuffled = df.orderBy(F.rand(7)).repartition(7)
    pick = [N.total(F.col("x"), 2).alias("t"), N.mean(F.col("x"), 2).alias("m")]
    assert df.agg(*pick).first() == shuffled.agg(*pick).first()
    assert df.where("false").agg(N.mean(F.col("x"), 2)).first()[0] is None


FUTURES, PUT = "Lean Hog Futures", "Lean Hog Put Option"


@pytest.mark.parametrize(
    ("kind", "price", "premium", "market", "expected"),
    [
        (FUTURES, 79.93, 0.0, 88.0, 79.93 - 88.0),
        (PUT, 93.23, 3.14, 87.83, 93.23 - 3.14 - 87.83 - 3.14),
        (PUT, 80.0, 3.0, 90.0, -3.0),
        ("LRP Policy", 100.0, 1.0, 90.0, 8.0),
        ("Swap", 100.0, 1.0, 90.0, 0.0),
        (FUTURES, 79.93, 0.0, None, None),
    ],
)
def test_pnl_per_cwt(spark, kind, price, premium, market, expected):
    got = one(spark, M.pnl_per_cwt(F.lit(kind), F.lit(price), F.lit(premium), F.lit(market).cast("double")))
    assert got == pytest.approx(expected) if expected is not None else got is None


def test_pnl_of_unknown_kind_may_be_null(spark):
    assert one(spark, M.pnl_per_cwt(F.lit("Swap"), F.lit(1.0), F.lit(1.0), F.lit(1.0), None)) is None


def test_scenario_pnl_without_market_costs_the_premium(spark):
    null = F.lit(None).cast("double")
    assert one(spark, M.scenario_pnl_per_cwt(F.lit(PUT), F.lit(90.0), F.lit(2.5), null)) == -2.5
    assert one(spark, M.scenario_pnl_per_cwt(F.lit(FUTURES), F.lit(90.0), F.lit(0.0), null)) is None


@pytest.mark.parametrize(
    ("kind", "market", "expected"),
    [
        (FUTURES, 100.0, (90 * 0.5 + 100 * 0.5) * 2.1 - 140),
        (PUT, 100.0, ((100 - 4) * 0.5 + 100 * 0.5) * 2.1 - 140),
        (PUT, 80.0, ((90 - 4) * 0.5 + 80 * 0.5) * 2.1 - 140),
        ("Swap", 100.0, 100 * 2.1 - 140),
        (FUTURES, 0.0, None),
        (FUTURES, None, None),
    ],
)
def test_blended_margin(spark, kind, market, expected):
    args = [F.lit(kind), F.lit(90.0), F.lit(4.0), F.lit(0.5), F.lit(market).cast("double"), F.lit(140.0)]
    got = one(spark, M.blended_margin(*args))
    assert got == pytest.approx(expected) if expected is not None else got is None


@pytest.mark.parametrize(
    ("margin", "coverage", "key", "label"),
    [
        (30.1, 0.5, "strong", "✅ Strong"),
        (30.0, 0.49, "on_track", "✅ On track ⚠️"),
        (15.0, 0.9, "watch", "🟡 Watch"),
        (5.0, 0.9, "tight", "🟡 Tight"),
        (0.0, None, "at_risk", "🔴 At risk"),
        (None, 0.1, "unknown", "⚪ N/A"),
    ],
)
def test_margin_bands(spark, margin, coverage, key, label):
    m, c = F.lit(margin).cast("double"), F.lit(coverage).cast("double")
    assert (one(spark, M.margin_status(m)), one(spark, M.margin_label(m, c))) == (key, label)


def test_feed_formulas(spark):
    corn = M.corn_usd_ton(F.lit(448.0))
    assert one(spark, corn) == pytest.approx(160.0)
    ton = M.feed_usd_ton(corn, F.lit(300.0))
    assert one(spark, ton) == pytest.approx(180.0)
    assert one(spark, M.feed_usd_head(ton)) == pytest.approx(72.0)


def test_display_forms(spark):
    assert one(spark, X.signed_money(F.lit(-1.5))) == "$-1.50"
    assert one(spark, X.signed_money(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, X.whole_percent(F.lit(0.865))) == "86%"


def test_names_for_matching():
    assert X.plain_name("Kill_Date ") == "kill date"
    assert X.spelled_name("Avg Wt (lb)") == "average weight pounds"

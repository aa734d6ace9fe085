"""Reports over the derived tables: overviews, logs, alerts and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.market import per_head_to_cwt
from paddock.functions.numeric import round_even, round_half_up
from paddock.functions.text import signed_money, whole_percent
from paddock.operators.aggregates import key_figures
from paddock.operators.joins import month_offset_lookup, pair_with, range_stats
from paddock.operators.timeline import drop_alerts, latest_rows, running_total, top_per_key

GROUP = "pig_group_id"

# Limits and states that call for a look at a group.
LOW_COVERAGE = 0.55
TIGHT_MARGIN = 30
WATCHED_HEALTH = ["Positive", "Monitored"]


def attention() -> Column:
    """Row predicate: low coverage, tight margin or a health state to watch."""
    return (
        (F.col("coverage_percent") < LOW_COVERAGE)
        | (F.col("est_margin") < TIGHT_MARGIN)
        | F.col("health_status").isin(WATCHED_HEALTH)
    )


def needs_attention(margins: DataFrame) -> DataFrame:
    return margins.where(attention())


def operation_figures(margins: DataFrame, *, scale: int | None = None) -> DataFrame:
    """One row: mean margin, heads, profit, and how many groups need a look."""
    return key_figures(
        margins,
        margin="est_margin",
        head="head_to_finisher",
        coverage="coverage_percent",
        attention=attention(),
        low_coverage=LOW_COVERAGE,
        tight_margin=TIGHT_MARGIN,
        scale=scale,
    )


def overview(margins: DataFrame) -> DataFrame:
    """All groups with display texts, earliest market date first."""
    return margins.select(
        F.col(GROUP).alias("group"),
        F.col("finisher_site").alias("site"),
        F.col("head_to_finisher").alias("head"),
        F.col("health_status").alias("health"),
        F.col("instrument_type").alias("instrument"),
        whole_percent(F.col("coverage_percent")).alias("coverage"),
        round_even(F.col("effective_floor_cwt"), 2).alias("floor"),
        round_even(F.col("current_market_cwt"), 2).alias("market"),
        signed_money(F.col("pnl_per_head")).alias("hedge_pnl_per_head"),
        signed_money(F.col("est_margin")).alias("margin_per_head"),
        F.date_format("est_market_date", "yyyy-MM-dd").alias("est_market"),
        F.col("status_label").alias("status"),
    ).orderBy("est_market", "group")


def locked_against_current(lifecycle: DataFrame, pnl: DataFrame) -> DataFrame:
    """Secured and current price per group, for groups that have both."""
    return (
        lifecycle.join(pnl.select(GROUP, "current_market_cwt", "pnl_per_head"), GROUP, "left")
        .select(
            GROUP,
            F.col("effective_floor_cwt").alias("locked"),
            F.col("current_market_cwt").alias("current"),
            F.col("pnl_per_head").alias("pnl"),
        )
        .dropna(subset=["locked", "current"])
        .orderBy(GROUP)
    )


def price_history(dashboard: DataFrame, days: int = 60) -> DataFrame:
    """Futures and cash price of the last days, oldest first."""
    return latest_rows(dashboard.select("date", "he_front_close", "national_cash"), ["date"], days)


def feed_history(feed: DataFrame, days: int = 60) -> DataFrame:
    """Corn price and feed cost of the last days, oldest first."""
    return latest_rows(feed.select("date", "corn_cents_bu", "feed_cost_per_head"), ["date"], days)


def feed_intake(consumption: DataFrame, group_id) -> DataFrame:
    """Actual and expected feed per head by day of one group."""
    return (
        consumption.where(F.col(GROUP) == F.lit(group_id))
        .select("day_in_finisher", "actual_feed_per_head_lb", "expected_feed_per_head_lb")
        .orderBy("day_in_finisher")
    )


def weekly_deaths(mortality: DataFrame, group_id=None) -> DataFrame:
    """Weekly deaths with running total, remaining heads and weekly rate, worked out again
    from the deaths and the heads at the start (``start_head``)."""
    rows = mortality if group_id is None else mortality.where(F.col(GROUP) == F.lit(group_id))
    summed = running_total(rows, [GROUP], ["week_number"], "deaths", name="__dead", scale=0)
    dead = F.col("__dead").cast("bigint")
    before = F.col("start_head") - dead + F.col("deaths")
    return (
        summed.withColumn("cumulative_deaths", dead)
        .withColumn("head_remaining", F.col("start_head") - dead)
        .withColumn("weekly_mortality_pct", round_even(F.col("deaths") / F.nullif(before, F.lit(0)) * 100, 2))
        .drop("__dead")
    )


def total_deaths(mortality: DataFrame) -> DataFrame:
    return mortality.groupBy(GROUP).agg(F.sum("deaths").alias("total_deaths"))


def treatments(logs: DataFrame, group_id) -> DataFrame:
    """Treatment log of one group in order of time."""
    return (
        logs.where(F.col(GROUP) == F.lit(group_id))
        .select("date", "treatment_type", "medication", "dose", "administered_by", "reason", "head_treated")
        .orderBy("date")
    )


def recent_per_group(
    lifecycle: DataFrame, log: DataFrame, place: str, log_place: str, order: Sequence[Column], k: int
) -> DataFrame:
    """The last ``k`` log rows of each group's site or barn: five deliveries, ten entries."""
    recent = top_per_key(log, [log_place], list(order), k).withColumnRenamed(log_place, place)
    return lifecycle.select(GROUP, place).join(recent, place)


def water_alerts(barn_env: DataFrame, *, scale: int | None = None, **options) -> DataFrame:
    """Barn days with water use below 85 percent of the 14 readings before."""
    alerts = drop_alerts(
        barn_env.where(F.col("date").isNotNull()),
        ["site", "barn"],
        ["date"],
        "water_usage_gallons",
        name="avg14",
        scale=scale,
        **options,
    )
    return alerts.withColumn("drop_pct", round_half_up(F.col("drop_pct"), 1))


def latest_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    return alerts.orderBy(F.desc("date"), "site", "barn").limit(n)


def outdoor_conditions(lifecycle: DataFrame, weather: DataFrame, *, scale: int | None = None) -> DataFrame:
    """Weather from placement to market for each group; weather has one site only."""
    return range_stats(
        lifecycle.select(GROUP, "placement_date", "est_market_date"),
        weather,
        "placement_date",
        "est_market_date",
        "date",
        {
            "avg_high": ("avg", F.col("outdoor_high_f"), scale),
            "avg_low": ("avg", F.col("outdoor_low_f"), scale),
            "max_gust": ("max", F.col("peak_wind_gust_mph")),
            "avg_wind": ("avg", F.col("avg_wind_mph"), scale),
        },
    )


def disease_risk(lifecycle: DataFrame, disease: DataFrame, *, season: str = "2024-25", name: str = "PRRS") -> DataFrame:
    """Disease level at placement, two months on, and the risk band of the rise."""
    index = disease.where((F.col("season") == season) & (F.col("disease") == name))
    return month_offset_lookup(
        lifecycle, index, "placement_date", "calendar_month", "cumulative_incidence_pct"
    ).withColumnsRenamed({"start_level": "level_at_placement", "end_level": "level_two_months_on"})


def quote_comparison(
    quotes: DataFrame, n: int = 10, *, commodity: str = "CME LEAN HOGS", coverage_from: float = 0.90, digits: int | None = 2
) -> DataFrame:
    """LRP cost per cwt against the put premium, highest coverage first.

    Of quotes alike in coverage, price and length the cheaper come first, by LRP cost and then by
    the put, so the quotes at the cut are always the same; what is missing comes last.
    """
    lrp = per_head_to_cwt(F.col("per_head_premium"))
    lrp = lrp if digits is None else round_half_up(lrp, digits)
    saved = F.col("cme_premium") - F.col("lrp_cost_cwt")
    return (
        quotes.where((F.col("commodity") == commodity) & (F.col("coverage_level_percent") >= coverage_from))
        .withColumn("lrp_cost_cwt", lrp)
        .select(
            "commodity",
            "coverage_level_percent",
            "coverage_price",
            "lrp_cost_cwt",
            F.col("cme_premium").alias("cme_put_cost_cwt"),
            "endorsement_length",
            (saved if digits is None else round_half_up(saved, digits)).alias("savings"),
        )
        .orderBy(F.desc("coverage_level_percent"), *map(F.asc_nulls_last, ("coverage_price", "endorsement_length", "lrp_cost_cwt", "cme_put_cost_cwt")))
        .limit(n)
    )


def packer_choices(groups: DataFrame, ranking: DataFrame, k: int = 3) -> DataFrame:
    """Each group with the best packers and what shipping there gains for its heads."""
    best = ranking.select("rank", "packer", "contract_type", "avg_eval_cwt", "advantage_per_head")
    return (
        pair_with(groups, best, ["rank"], k)
        .select(*groups.columns, "choice.*")
        .withColumn("savings", F.col("advantage_per_head") * F.col("head_to_finisher"))
    )

"""What-if sweeps. A list of scenario values is exploded in each row; nothing is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.market import (
    CWT_PER_HEAD,
    HEAD_PER_CONTRACT,
    corn_usd_ton,
    feed_usd_head,
    feed_usd_ton,
    scenario_pnl_per_cwt,
)
from paddock.functions.numeric import round_even


def sweep(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once per scenario value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def price_change(positions: DataFrame, deltas: Sequence[float]) -> DataFrame:
    """Positions revalued at the current market moved by each delta per cwt."""
    moved = sweep(positions, "delta_cwt", deltas).withColumn(
        "scenario_market", F.col("current_market_cwt") + F.col("delta_cwt")
    )
    pnl = scenario_pnl_per_cwt(
        F.col("instrument_type"), F.col("hedge_price_cwt"), F.col("premium_cwt"), F.col("scenario_market")
    )
    return (
        moved.withColumn("scenario_pnl_cwt", pnl)
        .withColumn("scenario_pnl_head", F.col("scenario_pnl_cwt") * CWT_PER_HEAD)
        .withColumn("scenario_total_pnl", F.col("scenario_pnl_head") * F.col("head_covered"))
    )


def feed_change(feed: DataFrame, corn_cents: Sequence[float], *, digits: int | None = 2) -> DataFrame:
    """Feed cost per head at other corn prices, from the latest row of the feed table."""
    latest = feed.orderBy(F.desc("date")).limit(1)
    scenario = feed_usd_head(feed_usd_ton(corn_usd_ton(F.col("scenario_corn_cents")), F.col("sbm_usd_ton")))

    def shown(col: Column) -> Column:
        return col if digits is None else round_even(col, digits)

    return sweep(latest, "scenario_corn_cents", corn_cents).select(
        F.col("corn_cents_bu").alias("current_corn_cents"),
        "scenario_corn_cents",
        shown(F.col("feed_cost_per_head")).alias("current_feed_per_head"),
        shown(scenario).alias("scenario_feed_per_head"),
        shown(scenario - F.col("feed_cost_per_head")).alias("delta_per_head"),
    )


def added_hedge(groups: DataFrame, percents: Sequence[float], *, digits: int | None = 1) -> DataFrame:
    """Coverage, heads and whole contracts after adding a percentage of coverage, at most
    all of the group. Works on all groups at once; filter first for a single one."""
    target = F.least(F.col("coverage_percent") + F.col("additional_pct") / 100, F.lit(1.0))
    covered = F.col("head_covered").cast("bigint")
    added = F.col("new_head_covered") - covered

    def shown(col: Column) -> Column:
        return col if digits is None else round_even(col, digits)

    return (
        sweep(groups, "additional_pct", percents)
        .withColumn("__target", target)
        .withColumn("new_head_covered", (F.col("head_to_finisher") * F.col("__target")).cast("bigint"))
        .select(
            "pig_group_id",
            "additional_pct",
            shown(F.col("coverage_percent") * 100).alias("current_coverage_pct"),
            shown(F.col("__target") * 100).alias("new_coverage_pct"),
            covered.alias("current_head_covered"),
            "new_head_covered",
            added.alias("additional_head"),
            F.floor(added / HEAD_PER_CONTRACT).alias("additional_contracts"),
            (F.col("head_to_finisher") - F.col("new_head_covered")).cast("bigint").alias("unhedged_after"),
        )
    )

"""Answers to the known intents, as functions from the derived tables to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import scenarios
from paddock.operators.routing import DEFAULT_CORN_CENTS, DEFAULT_COVERAGE_PCT, DEFAULT_PRICE_MOVE
from paddock.plans import views

GROUP = "pig_group_id"
Tables = Mapping[str, DataFrame]

_PNL = ["current_market_cwt", "pnl_per_cwt", "pnl_per_head", "total_pnl"]
_GROUP_COLUMNS = [
    GROUP, "finisher_site", "head_to_finisher", "instrument_type", "coverage_percent", "effective_floor_cwt",
    "unhedged_pct", "health_status", "est_market_date",
]
_SUMMARY_COLUMNS = [
    GROUP, "nursery_site", "finisher_site", "finisher_barn", "received_head", "head_to_finisher",
    "nursery_mortality_pct", "days_in_nursery", "est_market_date", "health_status", "instrument_type",
    "coverage_percent", "head_covered", "effective_floor_cwt", "unhedged_head", "contract_month",
    "nursery_avg_temp_f", "finisher_avg_temp_f",
]


def _marked(life: DataFrame, pnl: DataFrame, columns: list[str], pnl_columns: list[str], how: str = "left") -> DataFrame:
    groups = life.select(*[c for c in columns if c in life.columns])
    return groups.join(pnl.select(GROUP, *pnl_columns), GROUP, how)


def group_summary(tables: Tables, group_id) -> DataFrame:
    """One group with its position and mark."""
    one = tables["lifecycle"].where(F.col(GROUP) == F.lit(group_id))
    return _marked(one, tables["hedge_pnl"], _SUMMARY_COLUMNS, _PNL)


def all_groups(tables: Tables) -> DataFrame:
    return _marked(tables["lifecycle"], tables["hedge_pnl"], _GROUP_COLUMNS, _PNL).orderBy("est_market_date", GROUP)


def losing_groups(tables: Tables) -> DataFrame:
    """Groups whose position loses, the largest loss first."""
    losing = tables["hedge_pnl"].where(F.col("pnl_per_head") < 0)
    columns = ["hedge_price_cwt", "current_market_cwt", "pnl_per_head", "total_pnl"]
    marked = _marked(tables["lifecycle"], losing, [GROUP, "instrument_type", "coverage_percent"], columns, "inner")
    return marked.orderBy("total_pnl", GROUP)


def best_packer(tables: Tables) -> DataFrame:
    return tables["packer_ranking"].orderBy("rank")


def packer_for_group(tables: Tables, group_id, k: int = 3) -> DataFrame:
    group = tables["lifecycle"].where(F.col(GROUP) == F.lit(group_id)).select(GROUP, "head_to_finisher")
    return views.packer_choices(group, tables["packer_ranking"], k)


def hedge_comparison(tables: Tables, n: int = 10) -> DataFrame:
    return views.quote_comparison(tables["lrp_quotes"], n)


def barn_alerts(tables: Tables, n: int = 5, scale: int | None = None) -> DataFrame:
    return views.latest_alerts(views.water_alerts(tables["barn_env"], scale=scale), n)


def feed_cost(tables: Tables, days: int = 30) -> DataFrame:
    return tables["feed_cost"].orderBy(F.desc("date")).limit(days)


def market_context(tables: Tables, days: int = 30) -> DataFrame:
    return tables["hog_dashboard"].orderBy(F.desc("date")).limit(days)


def unhedged_exposure(tables: Tables, above_pct: float = 20) -> DataFrame:
    """Groups with an open share above a percentage, most open heads first."""
    columns = [
        GROUP, "head_to_finisher", "unhedged_head", "unhedged_pct", "instrument_type", "coverage_percent", "est_market_date",
    ]
    return (
        tables["lifecycle"].where(F.col("unhedged_pct") > above_pct).select(*columns).orderBy(F.desc("unhedged_head"), GROUP)
    )


def disease_context(tables: Tables, group_id=None, season: str = "2024-25") -> DataFrame:
    """Disease levels of a season by month; with a group, the risk during its nursery stay."""
    if group_id is None:
        return tables["disease"].where(F.col("season") == season).orderBy("calendar_month", "disease")
    group = tables["lifecycle"].where(F.col(GROUP) == F.lit(group_id)).select(GROUP, "placement_date", "health_status")
    return views.disease_risk(group, tables["disease"], season=season)


def low_coverage_list(groups: DataFrame, below: float = views.LOW_COVERAGE) -> DataFrame:
    """One row: the sorted groups with low coverage as one text, and their number."""
    low = groups.where(F.col("coverage_pct") < below).groupBy(GROUP).agg(F.count(F.lit(1)).alias("rows"))
    listed = F.array_join(F.sort_array(F.collect_list(F.col(GROUP).cast("string"))), ", ")
    return low.agg(listed.alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))


def weekly_summary(tables: Tables, below: float = views.LOW_COVERAGE) -> DataFrame:
    """Findings of the week, one row each: the strongest and weakest group by gain per
    head, every group with low coverage, the list of these groups as one text with their number,
    the best packer, the latest feed cost and, with barn readings at hand, the number of water
    alerts."""
    gain, groups = F.col("pnl_per_head"), tables["hedge_pnl"]
    low = F.col("coverage_pct") < below
    known = gain.isNotNull()
    name = F.col(GROUP).cast("string")
    # one pass: the best, the worst and the list; the list holds groups with low coverage only
    edges = groups.agg(
        F.min_by(F.struct(name.alias("s"), gain.alias("v")), F.when(known, F.struct(-gain, GROUP))).alias("strongest"),
        F.min_by(F.struct(name.alias("s"), gain.alias("v")), F.when(known, F.struct(gain, GROUP))).alias("weakest"),
    )
    rows = [
        edges.where(F.col(kind).isNotNull()).select(F.lit(kind).alias("finding"), F.col(f"{kind}.s").alias("subject"), F.col(f"{kind}.v").cast("double").alias("value"))
        for kind in ("strongest", "weakest")
    ]
    rows.append(groups.where(low).select(F.lit("low_coverage").alias("finding"), name.alias("subject"), F.col("coverage_pct").cast("double").alias("value")))
    rows.append(
        low_coverage_list(groups, below).select(F.lit("low_coverage_groups").alias("finding"), F.col("groups").alias("subject"), F.col("n").cast("double").alias("value"))
    )
    packer = tables["packer_ranking"].orderBy("rank").limit(1)
    rows.append(
        packer.select(
            F.lit("best_packer").alias("finding"),
            F.concat_ws(" ", "packer", "contract_type").alias("subject"),
            F.col("advantage_per_head").alias("value"),
        )
    )
    feed = tables["feed_cost"].orderBy(F.desc("date")).limit(1)
    rows.append(
        feed.select(F.lit("feed_cost").alias("finding"), F.col("date").cast("string").alias("subject"), F.col("feed_cost_per_head").alias("value"))
    )
    if "barn_env" in tables:
        alerts = views.water_alerts(tables["barn_env"]).agg(F.count(F.lit(1)).cast("double").alias("value"))
        rows.append(alerts.select(F.lit("barn_alerts").alias("finding"), F.lit("water").alias("subject"), "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def action_recommendation(tables: Tables, below: float = views.LOW_COVERAGE) -> DataFrame:
    """The group with the lowest coverage under the limit, its market, and the best packer.
    Empty when all groups are covered well enough."""
    lowest = (
        tables["hedge_pnl"]
        .where(F.col("coverage_pct") < below)
        .orderBy("coverage_pct", GROUP)
        .limit(1)
        .select(GROUP, "coverage_pct", "current_market_cwt")
    )
    columns = ("packer", "contract_type", "advantage_per_head")
    best = tables["packer_ranking"].orderBy("rank").limit(1).select(F.struct(*columns).alias("best"))
    return lowest.withColumn("__best", best.scalar()).select(*lowest.columns, *[F.col(f"__best.{c}").alias(c) for c in columns])


def scenario_price(tables: Tables, *deltas: float) -> DataFrame:
    return scenarios.price_change(tables["hedge_pnl"], deltas or (-DEFAULT_PRICE_MOVE,))


def scenario_feed(tables: Tables, *corn_cents: float) -> DataFrame:
    return scenarios.feed_change(tables["feed_cost"], corn_cents or (DEFAULT_CORN_CENTS,))


def scenario_add_hedge(tables: Tables, group_id=None, *percents: float) -> DataFrame:
    """Effect of more coverage, for one group or all, with the current market price."""
    groups = tables["lifecycle"]
    if group_id is not None:
        groups = groups.where(F.col(GROUP) == F.lit(group_id))
    added = scenarios.added_hedge(groups, percents or (DEFAULT_COVERAGE_PCT,))
    return added.join(tables["hedge_pnl"].select(GROUP, "current_market_cwt"), GROUP, "left")


INTENTS: dict[str, Callable[..., DataFrame]] = {
    "group_summary": group_summary,
    "all_groups": all_groups,
    "losing_groups": losing_groups,
    "best_packer": best_packer,
    "packer_for_group": packer_for_group,
    "hedge_comparison": hedge_comparison,
    "barn_alerts": barn_alerts,
    "feed_cost": feed_cost,
    "market_context": market_context,
    "unhedged_exposure": unhedged_exposure,
    "disease_context": disease_context,
    "weekly_summary": weekly_summary,
    "action_recommendation": action_recommendation,
    "scenario_price": scenario_price,
    "scenario_feed": scenario_feed,
    "scenario_add_hedge": scenario_add_hedge,
}


def answer(tables: Tables, intent: str, *, group_id=None, delta=None, corn_cents=None, pct=None) -> DataFrame:
    """Runs one routed question; unknown intents get the weekly summary."""
    if intent in ("group_summary", "packer_for_group", "disease_context"):
        return INTENTS[intent](tables, group_id)
    if intent == "scenario_price":
        return scenario_price(tables, *([] if delta is None else [delta]))
    if intent == "scenario_feed":
        return scenario_feed(tables, *([] if corn_cents is None else [corn_cents]))
    if intent == "scenario_add_hedge":
        return scenario_add_hedge(tables, group_id, *([] if pct is None else [pct]))
    return INTENTS.get(intent, weekly_summary)(tables)

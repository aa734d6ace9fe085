"""Derived tables of the operation, each a function from DataFrames to a DataFrame.

Inputs carry snake case names and parsed dates (see ``sources.readers``). ``scale`` is
the number of decimals of the measured values: with it, sums are exact and do not depend
on the order of partial results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions import market as M
from paddock.functions.dates import (
    contract_expiry,
    contract_is_unlisted,
    contract_month,
    contract_symbol,
    contract_year,
    contract_yyyymm,
)
from paddock.functions.numeric import ratio, round_even
from paddock.operators.aggregates import cost_summary, measures, monthly_totals, ranked_advantage, seasonal_profile
from paddock.operators.joins import (
    asof_nearest,
    latest_by_key,
    left_join_suffixed,
    nearest_value,
    period_benchmark,
    range_stats,
)
from paddock.sources.readers import path_exists, read_endpoint, read_other, read_producer
from paddock.sources.schemas import PRODUCER_SCHEMAS
from paddock.sources.writers import write_parquet

GROUP = "pig_group_id"
DAYS_TO_MARKET = 112
HEDGE_COLUMNS = [
    "instrument_type", "buy_sell", "trade_date", "expiration_date", "strike_or_futures_price_cwt",
    "option_or_lrp_premium_cwt", "contract_month", "coverage_percent", "head_covered", "contracts",
]


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def finisher_entries(flow: DataFrame, order: Sequence[str] = ("movement_date",)) -> DataFrame:
    """Last move of each group to a finisher site. Moves on the same day are told apart
    by the moved columns, or by a sequence column named in ``order``."""
    moved = {
        "finisher_entry_date": F.col("movement_date"),
        "finisher_site": F.col("to_site"),
        "finisher_barn": F.col("to_barn"),
        "head_to_finisher": F.col("head_moved"),
        "weight_at_finisher_entry": F.col("avg_weight_lb"),
    }
    tiebreak = [c for c in ("head_moved", "to_site", "to_barn") if c not in order]
    return latest_by_key(flow.where(F.col("to_site").contains("Finisher")), [GROUP], [*order, *tiebreak], moved)


def nursery_flow(nursery: DataFrame, flow: DataFrame, order: Sequence[str] = ("movement_date",)) -> DataFrame:
    """Nursery groups with their move to the finisher and what happened in between."""
    lost = F.col("received_head") - F.col("head_to_finisher")
    joined = nursery.join(finisher_entries(flow, order), GROUP, "left")
    return joined.withColumns(
        {
            "nursery_mortality": lost,
            "nursery_mortality_pct": round_even(ratio(lost.cast("double"), F.col("received_head").cast("double")) * 100, 1),
            "days_in_nursery": F.datediff("finisher_entry_date", "placement_date"),
            "nursery_weight_gain_lb": round_even(F.col("weight_at_finisher_entry") - F.col("avg_weight_in_lb"), 1),
            "est_market_date": F.date_add("finisher_entry_date", DAYS_TO_MARKET),
        }
    )


def _with_floor(df: DataFrame) -> DataFrame:
    floor = M.effective_floor(
        F.col("instrument_type"), F.col("strike_or_futures_price_cwt"), F.col("option_or_lrp_premium_cwt")
    )
    return df.withColumn("effective_floor_cwt", floor)


def _with_open_share(df: DataFrame, head: str) -> DataFrame:
    return df.withColumn("unhedged_head", F.col(head) - F.col("head_covered")).withColumn(
        "unhedged_pct", round_even((1 - F.col("coverage_percent")) * 100, 1)
    )


def nursery_hedging(nursery: DataFrame, hedging: DataFrame) -> DataFrame:
    """Nursery groups with their positions; open heads count from the heads received."""
    joined = left_join_suffixed(nursery, hedging, [GROUP], "_hedge")
    return _with_floor(_with_open_share(joined, "received_head"))


def lifecycle(
    nursery: DataFrame, flow: DataFrame, hedging: DataFrame, order: Sequence[str] = ("movement_date",)
) -> DataFrame:
    """Master table, one row per group: placement, finisher move and position. Open heads
    count from the heads that reached the finisher."""
    positions = hedging.select(GROUP, *_present(hedging, HEDGE_COLUMNS))
    joined = nursery_flow(nursery, flow, order).join(positions, GROUP, "left")
    return _with_open_share(_with_floor(joined), "head_to_finisher")


def barn_env_stats(
    groups: DataFrame, barn_env: DataFrame, *, cold_below: float = 40, scale: int | None = None
) -> DataFrame:
    """Barn readings during each group's nursery and finisher stay. The hand-over day
    counts in both phases. Both phases are measured in one pass over the readings."""
    stays = {
        "nursery": ("nursery_site", "nursery_barn", "placement_date", "finisher_entry_date"),
        "finisher": ("finisher_site", "finisher_barn", "finisher_entry_date", "est_market_date"),
    }
    spans = groups.select(
        GROUP,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(phase).alias("phase"), *[F.col(c).alias(n) for c, n in zip(cols, ("site", "barn", "low", "high"))])
                    for phase, cols in stays.items()
                ]
            )
        ).alias("s"),
    ).select(GROUP, "s.*")
    temperature = F.col("avg_temperature_f")
    stats = range_stats(
        spans,
        barn_env,
        "low",
        "high",
        "date",
        {
            "env_days": ("count", F.lit(1)),
            "avg_temp_f": ("avg", temperature, scale),
            "avg_humidity": ("avg", F.col("avg_humidity_pct"), scale),
            "avg_water": ("avg", F.col("water_usage_gallons"), scale),
            "temp_alerts": ("count_if", temperature < cold_below),
        },
        by=["site", "barn"],
    )
    names = ["env_days", "avg_temp_f", "avg_humidity", "avg_water", "temp_alerts"]
    return stats.groupBy(GROUP).agg(
        *[
            F.max(F.when(F.col("phase") == phase, F.col(n))).alias(f"{phase}_{n}")
            for phase in stays
            for n in names
        ]
    )


def lifecycle_with_env(groups: DataFrame, barn_env: DataFrame, **options) -> DataFrame:
    return groups.join(barn_env_stats(groups, barn_env, **options), GROUP)


def farrowing_supply(
    nursery: DataFrame,
    farrowing: DataFrame,
    *,
    source: str = "Internal Sow Farm",
    days_before: int = 14,
    farms_per_week: int = 3,
    scale: int | None = None,
) -> DataFrame:
    """Sow farm weeks up to two weeks before placement, for groups of an inside source.
    Groups without such weeks are left out."""
    groups = nursery.where(F.col("pig_source") == source).select(
        GROUP, F.date_sub("placement_date", days_before).alias("low"), F.col("placement_date").alias("high")
    )
    stats = range_stats(
        groups,
        farrowing,
        "low",
        "high",
        "week_start",
        {
            "farm_weeks": ("count", F.lit(1)),
            "total_weaned_in_window": ("sum", F.col("weaned_pigs"), scale),
            "deaths": ("sum", F.col("pre_wean_mortality_head"), scale),
            "live_born": ("sum", F.col("live_born"), scale),
            "avg_wean_weight_lb": ("avg", F.col("avg_wean_weight_lb"), scale),
            "farms_in_window": ("names", F.col("sow_farm")),
        },
        how="inner",
    )
    return stats.select(
        GROUP,
        F.floor(F.col("farm_weeks") / farms_per_week).alias("farrowing_weeks_matched"),
        F.col("total_weaned_in_window").cast("bigint").alias("total_weaned_in_window"),
        (ratio(F.col("deaths"), F.col("live_born")) * 100).alias("avg_prewean_mortality_pct"),
        "avg_wean_weight_lb",
        "farms_in_window",
    )


def cash_index(indexes: DataFrame, purchase_type: str = "Prod. Sold Negotiated") -> DataFrame:
    """Dated index value of one purchase type."""
    return indexes.where(F.col("purchase_type") == purchase_type).select(
        "report_date", F.col("amount").alias("cme_index_value")
    )


def packer_basis(
    packer: DataFrame,
    national: DataFrame,
    index: DataFrame,
    western: DataFrame | None = None,
    *,
    tolerance_days: int = 5,
    right_order: Sequence[str] = (),
) -> DataFrame:
    """Settlements with the sum of their price parts and their basis to the cash prices
    and the index reported nearest to the kill date; ``right_order`` says which of several
    reports of one day counts."""
    parts = ["base_price_cwt", "matrix_premium_cwt", "sort_loss_cwt", "vob_cwt"]
    out = packer.withColumn("eval_check", F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) + F.col(parts[3]))
    series = [("national_cash_cwt", "basis_vs_national", _cash(national, "national_cash_cwt"))]
    if western is not None:
        series.append(("western_cb_cash_cwt", "basis_vs_western_cb", _cash(western, "western_cb_cash_cwt")))
    series.append(("cme_index_value", "basis_vs_cme_index", index))
    # all series are matched on the distinct kill dates; the settlements are joined once
    dates = packer.where(F.col("kill_date").isNotNull()).select("kill_date").distinct()
    for value, _, table in series:
        order = [c for c in right_order if c in table.columns]
        dates = asof_nearest(dates, table, "kill_date", "report_date", [value], tolerance_days=tolerance_days, right_order=order)
    out = out.join(F.broadcast(dates), "kill_date", "left").select(*out.columns, *[v for v, _, _ in series])
    return out.withColumns({basis: F.col("base_price_cwt") - F.col(value) for value, basis, _ in series})


def _cash(table: DataFrame, name: str) -> DataFrame:
    return table.withColumn(name, F.col("wtd_avg"))


def positions_with_symbol(hedging: DataFrame, root: str = "HE") -> DataFrame:
    month = F.col("contract_month")
    return hedging.withColumn("symbol", contract_symbol(month, root)).withColumn(
        "symbol_is_fallback", contract_is_unlisted(month)
    )


def hedge_pnl(hedging: DataFrame, endpoint: DataFrame, *, commodity: str = "HE") -> DataFrame:
    """Positions marked to the last close of their contract."""
    marks = latest_by_key(
        endpoint.where(F.col("commodity") == commodity),
        ["symbol"],
        ["trading_day", "close"],
        {"current_market_cwt": F.col("close"), "market_date": F.col("trading_day")},
    )
    pnl = M.pnl_per_cwt(
        F.col("instrument_type"), F.col("hedge_price_cwt"), F.col("premium_cwt"), F.col("current_market_cwt")
    )
    return (
        positions_with_symbol(hedging, commodity)
        .join(marks, "symbol", "left")
        .select(
            GROUP,
            "symbol",
            "contract_month",
            "instrument_type",
            F.col("strike_or_futures_price_cwt").alias("hedge_price_cwt"),
            F.col("option_or_lrp_premium_cwt").alias("premium_cwt"),
            "current_market_cwt",
            "market_date",
            "head_covered",
            F.col("coverage_percent").alias("coverage_pct"),
        )
        .withColumn("pnl_per_cwt", pnl)
        .withColumn("pnl_per_head", F.col("pnl_per_cwt") * M.CWT_PER_HEAD)
        .withColumn("total_pnl", F.col("pnl_per_head") * F.col("head_covered"))
    )


def hedge_entry_price(hedging: DataFrame, endpoint: DataFrame, *, commodity: str = "HE", tolerance_days: int = 5) -> DataFrame:
    """Positions with the close of their contract nearest to the trade date."""
    closes = endpoint.where(F.col("commodity") == commodity).select("symbol", "trading_day", "close")
    found = asof_nearest(
        positions_with_symbol(hedging, commodity),
        closes,
        "trade_date",
        "trading_day",
        ["close"],
        by=["symbol"],
        tolerance_days=tolerance_days,
        matched_date="actual_trade_day",
        offset="days_offset",
    )
    return found.withColumnsRenamed({"close": "market_close_at_trade", "symbol": "lookup_symbol"})


def hedge_entry_bar(hedging: DataFrame, futures: DataFrame, *, root: str = "HE", tolerance_days: int = 5) -> DataFrame:
    """Positions with the full daily price bar of their contract nearest to the trade date."""
    return asof_nearest(
        positions_with_symbol(hedging, root),
        futures,
        "trade_date",
        "time",
        ["open", "high", "low", "close", "volume", "open_interest"],
        by=["symbol"],
        tolerance_days=tolerance_days,
        matched_date="ohlcv_date",
    ).withColumnRenamed("symbol", "lookup_symbol")


def _option_keys(hedging: DataFrame) -> DataFrame:
    return hedging.withColumn("grouping_date", contract_yyyymm(F.col("contract_month"))).withColumn(
        "strike_int", F.rint("strike_or_futures_price_cwt").cast("int")
    )


def put_premiums(hedging: DataFrame, lookup: DataFrame, *, name: str = "CME LEAN HOGS") -> DataFrame:
    """Put positions with the market premium of their month and whole strike."""
    market = lookup.where(F.col("name") == name).select(
        F.col("grouping_date").cast("int").alias("grouping_date"),
        F.col("strike").cast("int").alias("strike_int"),
        F.col("previous").alias("market_premium_cwt"),
    )
    puts = _option_keys(hedging.where(F.col("instrument_type") == M.PROTECTED[0]))
    return puts.join(market, ["grouping_date", "strike_int"], "left").withColumn(
        "premium_vs_market", F.col("option_or_lrp_premium_cwt") - F.col("market_premium_cwt")
    )


def lrp_premiums(hedging: DataFrame, quotes: DataFrame, *, name: str = "CME LEAN HOGS") -> DataFrame:
    """LRP positions with the quote of their month whose coverage price is nearest; of equally near
    quotes the lower ``quote_id``, or without ids the first by price, premiums and subsidy."""
    own = ["coverage_price", "per_head_premium", "producer_premium_amount", "subsidy_percent", "cme_premium"]
    quote = F.col("quote_id") if "quote_id" in quotes.columns else F.struct(*own)
    offered = quotes.where(F.col("commodity") == name).select(
        F.col("grouping_date").cast("int").alias("grouping_date"),
        "coverage_price",
        quote.alias("quote_id"),
        F.col("per_head_premium").alias("lrp_market_premium_per_head"),
        F.col("producer_premium_amount").alias("lrp_producer_premium"),
        F.col("subsidy_percent").alias("lrp_subsidy_pct"),
        F.col("cme_premium").alias("cme_equivalent_premium"),
    )
    held = _option_keys(hedging.where(F.col("instrument_type") == M.PROTECTED[1]))
    payload = ["lrp_market_premium_per_head", "lrp_producer_premium", "lrp_subsidy_pct", "cme_equivalent_premium"]
    matched = nearest_value(
        held, offered, "strike_or_futures_price_cwt", "coverage_price", payload,
        by=["grouping_date"], key="quote_id",
    )
    return matched.select(GROUP, *payload)


def hedge_vs_packer(
    hedging: DataFrame, packer: DataFrame, *, other: float | None = None, scale: int | None = None
) -> DataFrame:
    """Positions against the mean settlement prices of the month they target."""
    month = F.col("contract_month")
    joined = period_benchmark(
        hedging,
        packer,
        contract_year(month),
        contract_month(month),
        "kill_date",
        {"packer_avg_eval_cwt": "eval_price_cwt", "packer_avg_base_cwt": "base_price_cwt"},
        has_data="has_packer_data",
        scale=scale,
    )
    price, premium = F.col("strike_or_futures_price_cwt"), F.col("option_or_lrp_premium_cwt")
    return joined.select(
        GROUP,
        "contract_month",
        F.col("instrument_type").alias("instrument"),
        price.alias("hedge_price_cwt"),
        premium.alias("premium_cwt"),
        "packer_avg_eval_cwt",
        "packer_avg_base_cwt",
        M.pnl_per_cwt(F.col("instrument_type"), price, premium, F.col("packer_avg_eval_cwt"), other).alias(
            "proxy_hedge_pnl_cwt"
        ),
        "has_packer_data",
    )


def packer_ranking(packer: DataFrame, *, digits: int | None = 2, scale: int | None = None) -> DataFrame:
    """Packer and contract combinations by mean evaluated price."""
    combos = measures(
        packer,
        ["packer", "contract_type"],
        means={
            "avg_eval_cwt": "eval_price_cwt",
            "avg_matrix": "matrix_premium_cwt",
            "avg_sort_loss": "sort_loss_cwt",
            "avg_vob": "vob_cwt",
        },
        counts={"loads": "settlement_id"},
        sums={"total_head": "delivered_head"},
        scale=scale,
    ).withColumn("total_head", F.col("total_head").cast("bigint"))
    return ranked_advantage(combos, "avg_eval_cwt", ["packer", "contract_type"], digits=digits)


NO_EXPIRY = 1_000_000  # sorts after every contract month


def front_closes(endpoint: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per trading day with the front closes of several commodities ({commodity: name}).

    The front contract of a day is the one that expires first; of equal ones the lowest close counts.
    A close of a commodity without rows on a day is null, and so is ``has_<name>`` then. One pass over
    the table, in aggregates of primitive values: the lowest close per contract month, then that of the first month."""
    rows = endpoint.where(F.col("commodity").isin(*names) & F.col("trading_day").isNotNull())
    expiry = F.coalesce(contract_expiry(F.col("symbol")), F.lit(NO_EXPIRY))
    lowest = rows.groupBy("trading_day", "commodity", expiry.alias("__expiry")).agg(F.min("close").alias("__close"))
    first = {c: F.when(F.col("commodity") == c, F.col("__expiry")) for c in names}
    closes = lowest.groupBy(F.col("trading_day").alias("date")).agg(
        *[F.min_by("__close", first[c]).alias(n) for c, n in names.items()],
        *[F.bool_or(F.when(F.col("commodity") == c, True)).alias(f"has_{n}") for c, n in names.items()],
    )
    return closes


def daily_close(endpoint: DataFrame, commodity: str, name: str) -> DataFrame:
    """One close per day of a commodity: that of its front contract."""
    return front_closes(endpoint, {commodity: name}).select("date", name)


def feed_cost(endpoint: DataFrame, *, tolerance_days: int = 3) -> DataFrame:
    """Daily feed cost from corn and the soybean meal close nearest in time, of two equally near the earlier.

    Both closes lie on one line of days, as long as the calendar, so no join is needed."""
    closes = front_closes(endpoint, {"ZC": "corn_cents_bu", "ZM": "sbm_usd_ton"})
    meal = F.when(F.col("has_sbm_usd_ton"), F.struct("date", "sbm_usd_ton"))
    reach = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    line = closes.withColumns({"__past": F.last(meal, True).over(reach(F.asc("date"))), "__next": F.last(meal, True).over(reach(F.desc("date")))})
    days = lambda c: F.abs(F.datediff(F.col("date"), F.col(f"{c}.date")))
    later = F.col("__past").isNull() | (F.col("__next").isNotNull() & (days("__next") < days("__past")))
    near = line.where("has_corn_cents_bu").withColumn("__meal", F.when(later, F.col("__next")).otherwise(F.col("__past")))
    joined = near.select("date", "corn_cents_bu", F.when(days("__meal") <= tolerance_days, F.col("__meal.sbm_usd_ton")).alias("sbm_usd_ton"))
    return (
        joined.withColumn("corn_usd_ton", M.corn_usd_ton(F.col("corn_cents_bu")))
        .withColumn("feed_cost_usd_ton", M.feed_usd_ton(F.col("corn_usd_ton"), F.col("sbm_usd_ton")))
        .withColumn("feed_cost_per_head", M.feed_usd_head(F.col("feed_cost_usd_ton")))
    )


def hog_dashboard(endpoint: DataFrame, national: DataFrame, index: DataFrame, *, tolerance_days: int = 3) -> DataFrame:
    """Daily hog market: front close, national cash price, index and basis."""
    front = daily_close(endpoint, "HE", "he_front_close")
    cash = national.select("report_date", F.col("wtd_avg").alias("national_cash"))
    with_cash = asof_nearest(front, cash, "date", "report_date", ["national_cash"], tolerance_days=tolerance_days)
    both = asof_nearest(
        with_cash,
        index.withColumnRenamed("cme_index_value", "cme_index"),
        "date",
        "report_date",
        ["cme_index"],
        tolerance_days=tolerance_days,
    )
    return both.withColumn("basis", F.col("national_cash") - F.col("he_front_close"))


def seasonal_avg(endpoint: DataFrame, *, with_std: bool = False, scale: int | None = None) -> DataFrame:
    """Seasonal price profile of lean hogs."""
    hogs = endpoint.where(F.col("commodity") == "HE")
    return seasonal_profile(hogs, "trading_day", "close", with_std=with_std, scale=scale)


def cost_benchmarks(accounting: DataFrame, *, scale: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Monthly cost per site, phase and category; and the summary per phase and category."""
    monthly = monthly_totals(
        accounting, ["site", "production_phase", "cost_category"], "date", "total_cost", scale=scale
    )
    return monthly, cost_summary(accounting, ["production_phase", "cost_category"], "total_cost", scale=scale)


def margins(lifecycle_: DataFrame, pnl: DataFrame, feed: DataFrame, *, digits: int | None = 2) -> DataFrame:
    """Groups with mark, estimated margin per head and status. The cost is the feed cost
    of the latest day plus the fixed other cost."""
    last = feed.orderBy(F.desc("date")).limit(1)
    without = F.lit(M.FEED_COST_PER_HEAD_WITHOUT_DATA)
    # the fixed cost stands for a table without rows; a day without a meal price has no known cost
    latest = last.agg(F.when(F.count(F.lit(1)) == 0, without).otherwise(F.max("feed_cost_per_head")).alias("cost"))
    marked = lifecycle_.join(
        pnl.select(GROUP, "current_market_cwt", "pnl_per_cwt", "pnl_per_head", "total_pnl", F.col("symbol").alias("hedge_symbol")),
        GROUP,
        "left",
    ).withColumn(
        "__cost", latest.scalar() + M.NON_FEED_COST_PER_HEAD
    )
    margin = M.blended_margin(
        F.col("instrument_type"),
        F.col("strike_or_futures_price_cwt"),
        F.col("option_or_lrp_premium_cwt"),
        F.col("coverage_percent"),
        F.col("current_market_cwt"),
        F.col("__cost"),
    )
    return (
        marked.withColumn("est_margin", margin if digits is None else round_even(margin, digits))
        .withColumn("status_key", M.margin_status(F.col("est_margin")))
        .withColumn("status_label", M.margin_label(F.col("est_margin"), F.col("coverage_percent")))
        .drop("__cost")
    )


def build_all(
    spark: SparkSession,
    producer: dict[str, DataFrame],
    endpoint: DataFrame,
    national: DataFrame,
    indexes: DataFrame,
    extras: dict[str, DataFrame | None] | None = None,
) -> dict[str, DataFrame]:
    """All derived tables by name; optional inputs that are missing are left out."""
    life = lifecycle(producer["nursery"], producer["flow"], producer["hedging"])
    index = cash_index(indexes)
    tables = {
        "lifecycle": lifecycle_with_env(life, producer["barn_env"]),
        "hedge_pnl": hedge_pnl(producer["hedging"], endpoint),
        "packer_basis": packer_basis(producer["packer"], national, index),
        "packer_ranking": packer_ranking(producer["packer"]),
        "hedge_vs_packer": hedge_vs_packer(producer["hedging"], producer["packer"]),
        "feed_cost": feed_cost(endpoint),
        "hog_dashboard": hog_dashboard(endpoint, national, index),
        "seasonal_avg": seasonal_avg(endpoint),
        "barn_env": producer["barn_env"],
        "farrowing": producer["farrowing"],
        "accounting": producer["accounting"],
        "nursery": producer["nursery"],
        "endpointlist": endpoint,
    }
    return tables | {n: t for n, t in (extras or {}).items() if t is not None}


REQUIRED = [*PRODUCER_SCHEMAS, "endpointlist", "national", "indexes"]


def read_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Input tables by name from their files. Optional tables whose path holds nothing are left out; a
    required one that is missing is an error."""
    missing = [n for n in REQUIRED if n not in paths or not path_exists(spark, paths[n])]
    if missing:
        raise FileNotFoundError(f"no file for {', '.join(missing)}")
    present = [n for n in paths if n in REQUIRED or path_exists(spark, paths[n])]
    read = lambda n: read_producer if n in PRODUCER_SCHEMAS else read_other
    return {n: read_endpoint(spark, paths[n]) if n == "endpointlist" else read(n)(spark, n, paths[n]) for n in present}


def build_from_files(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """All derived tables from the input files, {table name: path}; the names are those of the producer
    tables, ``endpointlist`` and the tables of ``sources.schemas.OTHER_TABLES``."""
    inputs = read_inputs(spark, paths)
    producer = {n: inputs[n] for n in PRODUCER_SCHEMAS}
    extras = {n: t for n, t in inputs.items() if n not in REQUIRED and n != "western"}
    tables = build_all(spark, producer, inputs["endpointlist"], inputs["national"], inputs["indexes"], extras)
    if "western" in inputs:
        tables["packer_basis"] = packer_basis(producer["packer"], inputs["national"], cash_index(inputs["indexes"]), inputs["western"])
    return tables


def write_all(tables: dict[str, DataFrame], folder: str) -> list[dict]:
    """Writes every derived table as Parquet; returns the manifest entries. Futures closes are dealt to
    ranges of (commodity, day) first, so that a commodity's folder gets one file a range and not one a task."""
    closes = {n: t.repartitionByRange("commodity", "trading_day").sortWithinPartitions("commodity", "trading_day") for n, t in tables.items() if n == "endpointlist"}
    return [
        write_parquet(closes.get(n, t), folder, n, ["commodity"] if n in closes else []) for n, t in tables.items()
    ]

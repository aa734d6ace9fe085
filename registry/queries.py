"""Registered queries: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.dates import contract_yyyymm, parse_date, parse_yyyymmdd
from paddock.functions.numeric import clip, flag, from_units, to_units
from paddock.functions.text import comma_number, lookup, snake_columns, strip_columns, to_number
from paddock.operators import aggregates as agg
from paddock.operators import claims, joins, quality, routing, scenarios, timeline
from paddock.operators.cleaning import CleaningSpec, clean, count_outside, generic_spec
from paddock.plans import build, cleanup, questions, uploads, views
from paddock.sources.schemas import FieldRule
from paddock.sources.writers import table_facts
from registry.bindings import shape, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
POINT_USER = 7


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, as the oracle returns them."""

    def out(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return col.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            return col.cast("double").alias(f.name)
        return col

    return df.select(*[out(f) for f in df.schema.fields])


class Tables:
    """Test tables and domain bindings by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        return shape(self.spark, self.sf_dir, name)

    @property
    def orders_dated(self) -> DataFrame:
        return self.orders.withColumn("order_date", F.to_date("o_orderdate"))

    @property
    def lineitem_dated(self) -> DataFrame:
        return self.lineitem.withColumn("ship_date", F.to_date("l_shipdate"))

    def lifecycle(self) -> DataFrame:
        return build.lifecycle(self.nursery, self.flow, self.hedging, ["movement_date", "move_id"])

    def pnl(self) -> DataFrame:
        return build.hedge_pnl(self.hedging, self.endpoint)

    def index(self) -> DataFrame:
        return build.cash_index(self.indexes)

    def feed(self) -> DataFrame:
        return build.feed_cost(self.endpoint)

    def dashboard(self) -> DataFrame:
        return build.hog_dashboard(self.endpoint, self.national, self.index())

    def ranking(self) -> DataFrame:
        return build.packer_ranking(self.packer, scale=2)

    def margins(self) -> DataFrame:
        return build.margins(self.lifecycle(), self.pnl(), self.feed())

    def stays(self) -> DataFrame:
        """Per barn: first to tenth day as nursery stay, tenth to last as finisher stay."""
        days = self.barn_env.groupBy("site", "barn").agg(F.min("date").alias("placement_date"), F.max("date").alias("est_market_date"))
        return days.select(
            F.col("barn").alias("pig_group_id"),
            *[F.col("site").alias(c) for c in ("nursery_site", "finisher_site")],
            *[F.col("barn").alias(c) for c in ("nursery_barn", "finisher_barn")],
            "placement_date",
            F.date_add("placement_date", 10).alias("finisher_entry_date"),
            "est_market_date",
        )

    def barn_days(self) -> DataFrame:
        """One reading per site, barn and day."""
        return self.barn_env.groupBy("site", "barn", "date").agg(
            agg.total(F.col("water_usage_gallons"), 2).alias("water_usage_gallons"),
            F.max("avg_temperature_f").alias("avg_temperature_f"),
        )

    def disease(self) -> DataFrame:
        """Monthly index of one season, worked out from the orders of each month."""
        level = agg.mean(F.col("o_totalprice"), 2) / 50000
        months = self.orders.groupBy(F.month("o_orderdate").alias("calendar_month")).agg(level.alias("cumulative_incidence_pct"))
        return months.select(F.lit("PRRS").alias("disease"), F.lit("2024-25").alias("season"), "*")

    def answers(self) -> questions.Tables:
        return Answers(self)


class Answers(dict):
    """Derived tables by name, put together when they are first asked for."""

    MAKERS = {
        "lifecycle": Tables.lifecycle,
        "hedge_pnl": Tables.pnl,
        "packer_ranking": Tables.ranking,
        "feed_cost": Tables.feed,
        "hog_dashboard": Tables.dashboard,
        "barn_env": Tables.barn_days,
        "disease": Tables.disease,
    }

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __contains__(self, name: object) -> bool:
        return name in self.MAKERS

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.MAKERS[name](self.tables)
        return self[name]


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir)))
    return fn


# Lifecycle and joins -----------------------------------------------------------------


@query
def q_lifecycle(t: Tables) -> DataFrame:
    return t.lifecycle()


@query
def q_nursery_hedging(t: Tables) -> DataFrame:
    return build.nursery_hedging(t.nursery, t.hedging.withColumn("health_status", F.col("buy_sell")))


@query
def q_asof_nearest(t: Tables) -> DataFrame:
    prices = t.lineitem_dated
    return joins.asof_nearest(
        t.orders_dated.select("o_orderkey", "order_date"),
        prices.select("ship_date", F.col("l_extendedprice").alias("price")),
        "order_date", "ship_date", ["price"], matched_date="price_date", offset="days_offset",
    )


@query
def q_asof_chain(t: Tables) -> DataFrame:
    return t.dashboard()


@query
def q_packer_basis(t: Tables) -> DataFrame:
    return build.packer_basis(t.packer, t.national, t.index(), t.western, tolerance_days=2)


@query
def q_asof_keyed(t: Tables) -> DataFrame:
    return joins.asof_nearest(
        t.orders_dated.select(F.col("o_orderkey").alias("orderkey"), "order_date"),
        t.lineitem_dated.select(F.col("l_orderkey").alias("orderkey"), "ship_date", "l_linenumber", "l_extendedprice"),
        "order_date", "ship_date", ["l_linenumber", "l_extendedprice"],
        by=["orderkey"], tolerance_days=400, matched_date="matched_date", offset="days_offset",
    )


@query
def q_hedge_entry_price(t: Tables) -> DataFrame:
    return build.hedge_entry_price(t.hedging, t.endpoint).select(
        "pig_group_id", "lookup_symbol", "symbol_is_fallback", "trade_date", "market_close_at_trade", "actual_trade_day", "days_offset"
    )


@query
def q_hedge_entry_bar(t: Tables) -> DataFrame:
    return build.hedge_entry_bar(t.hedging, t.futures, tolerance_days=3).select(
        "pig_group_id", "lookup_symbol", "ohlcv_date", "open", "high", "low", "close", "volume", "open_interest"
    )


@query
def q_interval_stats(t: Tables) -> DataFrame:
    return build.barn_env_stats(t.stays(), t.barn_env, scale=2)


@query
def q_range_window(t: Tables) -> DataFrame:
    return build.farrowing_supply(t.nursery, t.farrowing, scale=2)


@query
def q_range_global(t: Tables) -> DataFrame:
    return views.outdoor_conditions(t.stays(), t.weather, scale=3)


@query
def q_nearest_value(t: Tables) -> DataFrame:
    return joins.nearest_value(
        t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal"),
        t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal"),
        "c_acctbal", "s_acctbal", ["s_suppkey"], by=["nation"], key="s_suppkey",
    )


@query
def q_lrp_premiums(t: Tables) -> DataFrame:
    return build.lrp_premiums(t.hedging, t.lrp_quotes)


@query
def q_composite_join(t: Tables) -> DataFrame:
    market = t.lookup_cme.groupBy("name", "grouping_date", "strike").agg(F.min("previous").alias("previous"))
    return build.put_premiums(t.hedging, market).select(
        "pig_group_id", "grouping_date", "strike_int", "market_premium_cwt", "premium_vs_market"
    )


@query
def q_contract_months(t: Tables) -> DataFrame:
    month = F.col("contract_month")
    return build.positions_with_symbol(t.hedging).select(
        "pig_group_id", "contract_month", "symbol", "symbol_is_fallback", contract_yyyymm(month).alias("yyyymm")
    )


@query
def q_latest_mark(t: Tables) -> DataFrame:
    return t.pnl()


@query
def q_period_benchmark(t: Tables) -> DataFrame:
    return build.hedge_vs_packer(t.hedging, t.packer, scale=2)


@query
def q_orphans(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("orderkey"))
    return joins.orphan_keys(t.orders.select(F.col("o_orderkey").alias("orderkey")), lines, "orderkey")


@query
def q_shared(t: Tables) -> DataFrame:
    documents = t.documents.select(F.col("doc_id").alias("id"))
    return joins.shared_keys(documents, t.labels.select(F.col("doc_id").alias("id")), "id")


@query
def q_overlap(t: Tables) -> DataFrame:
    return cleanup.key_checks(
        t.orders.select(F.col("o_orderkey").alias("pig_group_id")),
        {"lines": t.lineitem.select(F.col("l_orderkey").alias("pig_group_id")), "documents": t.documents.select(F.col("doc_id").alias("pig_group_id"))},
    )


@query
def q_scalar_broadcast(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(to_units(F.col("o_totalprice"), 2)).alias("spent"))
    revenue = (
        per_customer.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
        .groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("spent").alias("revenue"))
        .join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
        .select("n_name", from_units(F.col("revenue"), 2).alias("revenue"))
    )
    return joins.with_scalars(revenue, lowest=revenue.agg(F.min("revenue"))).withColumn("lead", F.col("revenue") - F.col("lowest"))


@query
def q_month_offset(t: Tables) -> DataFrame:
    return views.disease_risk(t.nursery.select("pig_group_id", "placement_date"), t.disease())


@query
def q_topk_per_group(t: Tables) -> DataFrame:
    nations = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = t.orders_dated.select("o_custkey", "o_orderkey", "order_date").join(nations, "o_custkey")
    return timeline.top_per_key(orders, ["c_nationkey"], [F.desc("order_date"), F.desc("o_orderkey")], 5)


@query
def q_recent_deliveries(t: Tables) -> DataFrame:
    log = t.orders_dated.select(F.concat(F.lit("Nursery "), (F.col("o_custkey") % 25).cast("string")).alias("site"), "o_orderkey", "order_date")
    return views.recent_per_group(t.nursery, log, "nursery_site", "site", [F.desc("order_date"), F.desc("o_orderkey")], 5)


@query
def q_group_topk_pair(t: Tables) -> DataFrame:
    groups = t.lifecycle().select("pig_group_id", "head_to_finisher")
    return views.packer_choices(groups, t.ranking())


@query
def q_inner_losing(t: Tables) -> DataFrame:
    return questions.losing_groups(t.answers())


@query
def q_left_overview(t: Tables) -> DataFrame:
    return views.overview(t.margins())


@query
def q_locked_vs_current(t: Tables) -> DataFrame:
    return views.locked_against_current(t.lifecycle(), t.pnl())


# Aggregates ----------------------------------------------------------------------------


@query
def q_rank_combo(t: Tables) -> DataFrame:
    return t.ranking()


@query
def q_first_last(t: Tables) -> DataFrame:
    rows = t.lineitem_dated
    order = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    price = F.col("l_extendedprice")
    return joins.first_and_last_by_key(rows, ["ship_date"], order, {"first_price": price}, {"last_price": price})


@query
def q_seasonal(t: Tables) -> DataFrame:
    return build.seasonal_avg(t.endpoint, with_std=True, scale=2)


@query
def q_cost_benchmark(t: Tables) -> DataFrame:
    return build.cost_benchmarks(t.accounting, scale=2)[0]


@query
def q_cost_summary(t: Tables) -> DataFrame:
    return build.cost_benchmarks(t.accounting, scale=2)[1]


@query
def q_kpi(t: Tables) -> DataFrame:
    return views.operation_figures(t.margins(), scale=2)


@query
def q_exposure(t: Tables) -> DataFrame:
    open_heads = questions.unhedged_exposure({"lifecycle": t.lifecycle()})
    return agg.exposure(open_heads.withColumn("pig_group_id", F.concat(F.lit("PG-"), "pig_group_id")), "pig_group_id", "unhedged_head")


@query
def q_unhedged(t: Tables) -> DataFrame:
    return questions.unhedged_exposure({"lifecycle": t.lifecycle()})


@query
def q_total_deaths(t: Tables) -> DataFrame:
    return views.total_deaths(t.mortality)


@query
def q_ratio_of_sums(t: Tables) -> DataFrame:
    return t.farrowing.groupBy("sow_farm").agg(
        agg.ratio_of_sums(F.col("pre_wean_mortality_head"), F.col("live_born")).alias("mortality_pct")
    )


# Timelines -----------------------------------------------------------------------------


def _readings(t: Tables) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", "value")


@query
def q_alert(t: Tables) -> DataFrame:
    alerts = timeline.drop_alerts(_readings(t), ["user_id"], ["ts", "event_id"], "value", scale=2)
    return alerts.select("user_id", "event_id", "value", "trailing_avg", "drop_pct")


@query
def q_alert_topk(t: Tables) -> DataFrame:
    return questions.barn_alerts({"barn_env": t.barn_days()}, scale=2).select(
        "site", "barn", "date", "water_usage_gallons", "avg14", "avg_temperature_f", "drop_pct"
    )


@query
def q_water_alerts(t: Tables) -> DataFrame:
    return views.water_alerts(t.barn_days(), scale=2, rows=7, positive_only=False).select("site", "barn", "date", "avg14", "drop_pct")


@query
def q_running(t: Tables) -> DataFrame:
    total = timeline.running_total(_readings(t), ["user_id"], ["ts", "event_id"], "value", scale=2)
    return total.select("user_id", "event_id", "value", "running_total")


@query
def q_weekly_deaths(t: Tables) -> DataFrame:
    return views.weekly_deaths(t.mortality)


@query
def q_latest_n(t: Tables) -> DataFrame:
    return views.price_history(t.dashboard())


@query
def q_feed_history(t: Tables) -> DataFrame:
    return views.feed_history(t.feed())


@query
def q_market_context(t: Tables) -> DataFrame:
    return questions.market_context({"hog_dashboard": t.dashboard()})


# Lookups and predicates ----------------------------------------------------------------


@query
def q_point_lookup(t: Tables) -> DataFrame:
    return views.feed_intake(t.consumption, POINT_USER)


@query
def q_treatments(t: Tables) -> DataFrame:
    return views.treatments(t.treatment_logs, POINT_USER)


@query
def q_group_summary(t: Tables) -> DataFrame:
    return questions.group_summary({"lifecycle": t.lifecycle(), "hedge_pnl": t.pnl()}, POINT_USER)


@query
def q_all_groups(t: Tables) -> DataFrame:
    return questions.all_groups({"lifecycle": t.lifecycle(), "hedge_pnl": t.pnl()})


@query
def q_packer_for_group(t: Tables) -> DataFrame:
    return questions.packer_for_group({"lifecycle": t.lifecycle(), "packer_ranking": t.ranking()}, POINT_USER)


@query
def q_attention(t: Tables) -> DataFrame:
    return views.needs_attention(t.margins()).select("pig_group_id", "coverage_percent", "est_margin", "health_status", "status_key")


# Cleaning ------------------------------------------------------------------------------


@query
def q_clean_text(t: Tables) -> DataFrame:
    return snake_columns(strip_columns(t.raw_rows.select("Order Key", "Order-Date", "Pct%", "Priority")))


@query
def q_clean_types(t: Tables) -> DataFrame:
    raw = t.raw_rows
    return raw.select(
        F.col("Order Key").alias("order_key"),
        parse_date(F.col("Order-Date")).alias("order_date"),
        parse_yyyymmdd(F.col("Compact")).alias("compact"),
        comma_number(F.col("Total$")).alias("total"),
        to_number(F.col("Pct%")).alias("pct"),
    )


@query
def q_flags_clip(t: Tables) -> DataFrame:
    units = {"A": "usd/cwt", "N": "cents/bushel"}
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        lookup(F.col("l_returnflag"), units).alias("price_unit"),
        flag(F.when(F.col("l_tax") > 0, F.col("l_discount")) < 0.03).alias("is_small"),
        clip(F.when(F.col("l_tax") > 0, F.col("l_discount")), 0.02, 0.08).alias("clipped"),
    )


@query
def q_clip_counts(t: Tables) -> DataFrame:
    return count_outside(t.lineitem, "l_discount", 0.02, 0.08)


@query
def q_drop_nulls_const(t: Tables) -> DataFrame:
    spec = CleaningSpec(
        require=("Total$",), dates=("Order-Date",), compact_dates=("Compact",), comma_numbers=("Total$",),
        drop_mostly_null=True, drop_constant=True, drop=("Priority",), sort=("order_date",),
    )
    return clean(t.raw_rows, spec).table


@query
def q_rename(t: Tables) -> DataFrame:
    spec = CleaningSpec(rename={"Pct%": "Share", "Priority": "Order Priority"}, drop_mostly_null=True, drop_constant=True, keep_constant=("Constant",))
    return clean(t.raw_rows, spec).table


@query
def q_generic(t: Tables) -> DataFrame:
    raw = t.raw_rows
    return clean(raw, generic_spec(("Order-Date", "Report-Date"), raw.columns)).table


@query
def q_union(t: Tables) -> DataFrame:
    slices = [
        t.customer.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_mktsegment", F.lit(segment.lower()).alias("source"))
        for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    ]
    return reduce(DataFrame.unionByName, slices)


# Market formulas and scenarios -----------------------------------------------------------


@query
def q_feed_cost(t: Tables) -> DataFrame:
    return t.feed()


@query
def q_margin(t: Tables) -> DataFrame:
    return t.margins().select(
        "pig_group_id", "instrument_type", "current_market_cwt", "est_margin", "status_key", "status_label"
    )


@query
def q_premium_compare(t: Tables) -> DataFrame:
    return views.quote_comparison(t.lrp_quotes)


@query
def q_scenario_price(t: Tables) -> DataFrame:
    moved = scenarios.price_change(t.pnl(), [-10, -5, 5, 10])
    cents = [F.rint(F.col(c) * 100).cast("bigint").alias(c) for c in ("total_pnl", "scenario_total_pnl")]
    return agg.scenario_totals(
        moved.select("delta_cwt", "scenario_pnl_head", *cents), "total_pnl", "scenario_total_pnl", "scenario_pnl_head", ["delta_cwt"]
    )


@query
def q_scenario_rows(t: Tables) -> DataFrame:
    return questions.scenario_price({"hedge_pnl": t.pnl()}, -5).select(
        "pig_group_id", "delta_cwt", "scenario_market", "scenario_pnl_cwt", "scenario_pnl_head", "scenario_total_pnl"
    )


@query
def q_scenario_cost(t: Tables) -> DataFrame:
    return scenarios.feed_change(t.feed(), [300, 500, 800])


@query
def q_scenario_hedge(t: Tables) -> DataFrame:
    groups = t.lifecycle().where(F.col("head_to_finisher").isNotNull() & F.col("head_covered").isNotNull())
    return scenarios.added_hedge(groups, [10, 20, 50])


@query
def q_recommend(t: Tables) -> DataFrame:
    return questions.action_recommendation(t.answers())


@query
def q_insight(t: Tables) -> DataFrame:
    return questions.weekly_summary(t.answers())


# Quality ---------------------------------------------------------------------------------


@query
def q_profile(t: Tables) -> DataFrame:
    raw = t.raw_rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in t.raw_rows.columns])
    return quality.profile(raw).select("column", "n_rows", "n_values", "numeric_rate", "type", "null_rate")


@query
def q_distinct_counts(t: Tables) -> DataFrame:
    return quality.distinct_counts(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"])


@query
def q_null_rate(t: Tables) -> DataFrame:
    return agg.mean_null_rate(t.raw_rows)


def _uploaded(t: Tables) -> DataFrame:
    """The packer table under names of another system."""
    return t.packer.select(
        F.col("kill_date").cast("string").alias("kill dt"),
        F.col("packer").alias("Packer"),
        F.col("contract_type").alias("ContractType"),
        F.col("delivered_head").alias("Hd Delivered"),
        F.col("base_price_cwt").alias("BASE_PRICE_CWT"),
        F.col("matrix_premium_cwt").alias("matrix premium"),
        F.col("sort_loss_cwt").alias("sort loss"),
    )


@query
def q_match(t: Tables) -> DataFrame:
    found = uploads.propose(_uploaded(t), "Packer Settlement").mapping
    rows = [(m.column, m.target, float(m.confidence), m.method) for m in found]
    matches = t.spark.createDataFrame(rows, "column string, target string, confidence double, method string")
    return matches.withColumn("band", quality.confidence_band(F.col("confidence")))


@query
def q_detect(t: Tables) -> DataFrame:
    found = uploads.propose(_uploaded(t))
    rows = [(n, float(s), n == found.schema, found.confidence) for n, s in found.scores.items()]
    return t.spark.createDataFrame(rows, "schema string, score double, is_best boolean, confidence string")


@query
def q_map(t: Tables) -> DataFrame:
    uploaded = _uploaded(t)
    return uploads.check(uploaded, uploads.propose(uploaded))[0]


ORDER_RULES = [
    FieldRule("o_orderkey", "numeric", "Order", required=True, minimum=1),
    FieldRule("o_totalprice", "numeric", "Price", minimum=10000, maximum=400000),
    FieldRule("o_orderstatus", "category", "State", values=("F", "O")),
    FieldRule("o_orderpriority", "string", "Priority", required=True, pattern=r"^[1-4]-"),
    FieldRule("mostlyNull", "string", "Mostly empty", required=True),
    FieldRule("Order-Date", "date", "Raw date"),
]


def _ruled(t: Tables) -> DataFrame:
    raw = t.raw_rows.select(F.col("Order Key").alias("o_orderkey"), "Order-Date", "mostlyNull")
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").join(raw, "o_orderkey")


@query
def q_validate(t: Tables) -> DataFrame:
    return quality.validate(_ruled(t), ORDER_RULES, check_patterns=True)


@query
def q_validate_rows(t: Tables) -> DataFrame:
    return quality.invalid_rows(t.orders, ORDER_RULES[:4], check_patterns=True).select("o_orderkey", "broken_rules")


@query
def q_unexpected_values(t: Tables) -> DataFrame:
    return quality.unexpected_values(t.events, "event_type", ["click", "view"])


@query
def q_reconcile(t: Tables) -> DataFrame:
    return cleanup.head_reconciliation(t.nursery, t.flow, ["movement_date", "move_id"])


@query
def q_claims(t: Tables) -> DataFrame:
    """Uploads (suppliers) whose columns (parts) claim fields (quantities) by how much they have in common; all want the first field."""
    rows = t.lineitem.select(
        F.expr("l_suppkey % 40").alias("upload"), F.expr("l_partkey % 9").alias("position"), F.concat(F.lit("f"), F.expr("(l_orderkey % 7) * (l_linenumber % 3)").cast("string")).alias("target")
    )
    scores = rows.groupBy("upload", "position", "target").agg((F.count(F.lit(1)) % 20 / 20 + F.when(F.col("target") == "f0", 0.5).otherwise(0.0)).alias("score"))
    named = scores.withColumn("column", F.concat(F.lit("c"), F.col("position").cast("string")))
    return claims.assign(named, "upload", "column", "position", "target", "score").select("upload", "column", "target", "score", "outcome")


@query
def q_identity(t: Tables) -> DataFrame:
    p, f, b = t.packer, t.farrowing, t.futures
    parts = [F.col(c) for c in ("base_price_cwt", "matrix_premium_cwt", "sort_loss_cwt", "vob_cwt")]
    checks = [
        quality.identity_checks(p, {"eval_price": quality.sums_to(F.col("eval_price_cwt"), parts, 0.01)}),
        quality.identity_checks(f, {"weaned": quality.sums_to(F.col("live_born"), [F.col("weaned_pigs"), F.col("pre_wean_mortality_head")], 0)}),
        quality.identity_checks(
            t.lineitem, {"line_total": quality.sums_to(F.col("l_extendedprice"), [F.col("l_quantity") * F.rint(F.col("l_extendedprice") / F.col("l_quantity"))], 10.0)}
        ),
        quality.identity_checks(b, {"ohlc": quality.ohlc_bounds()}),
        quality.identity_checks(t.accounting, {"total_cost": quality.product_of(F.col("total_cost"), F.col("quantity"), F.col("unit_cost"), 0.01)}),
    ]
    return reduce(DataFrame.unionByName, checks)


# Routing and manifest ------------------------------------------------------------------


@query
def q_route(t: Tables) -> DataFrame:
    turns = t.conversations.where(F.col("role") == "user")
    return routing.route(turns).select("conv_id", "turn", "intent", "group_id")


@query
def q_params(t: Tables) -> DataFrame:
    return routing.route(t.questions).select("event_id", "intent", "group_id", "delta", "corn_cents", "pct")


@query
def q_manifest(t: Tables) -> DataFrame:
    return table_facts({n: getattr(t, n) for n in TABLES})

"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from registry.bindings import cte
from registry.queries import POINT_USER, TABLES

DERIVED: dict[str, tuple[list[str], str]] = {}
ORACLES: dict[str, str] = {}

_EVEN = "(round_even({} * {f}, 0) / {f} + 0::double)"


def even(expr: str, digits: int) -> str:
    return _EVEN.format(f"({expr})", f=f"{10**digits}.0::double")


def half_up(expr: str, digits: int) -> str:
    """As the source's SQL rounds: half away from zero."""
    return f"(round({expr}, {digits}) + 0::double)"


def total(expr: str, scale: int = 2) -> str:
    return f"cast(sum(cast({expr} as decimal(18,{scale}))) as double)"


def mean(expr: str, scale: int = 2) -> str:
    return f"{total(expr, scale)} / nullif(count({expr}), 0)"


def _needed(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n in DERIVED:
            _needed(DERIVED[n][0], seen)
        if n not in seen:
            seen.append(n)
    return seen


def sql(names: str, body: str) -> str:
    """A query over bindings and derived tables, given by name."""
    parts = [f"{n} AS ({DERIVED[n][1]})" if n in DERIVED else cte(n) for n in _needed(names.split(), [])]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def nearest(left: str, right: str, on: str, right_on: str, value: str, out: str, tolerance: int, by: str = "") -> str:
    """One value of the nearest right date per distinct left (by, date)."""
    keys = f"{by}, " if by else ""
    same = f"l.{by} = r.{by} AND " if by else ""
    lkeys = f"l.{by}, " if by else ""
    return f"""
      SELECT {lkeys} l.{on}, r.v AS {out}, r.d AS {out}_date, abs(datediff('day', l.{on}, r.d)) AS {out}_off
      FROM (SELECT DISTINCT {keys} {on} FROM {left}) l
      JOIN (SELECT {keys} {right_on} AS d, min({value}) AS v FROM {right} GROUP BY {keys} {right_on}) r
        ON {same} r.d BETWEEN l.{on} - {tolerance} AND l.{on} + {tolerance}
      QUALIFY row_number() OVER (PARTITION BY {lkeys} l.{on} ORDER BY abs(datediff('day', l.{on}, r.d)), r.d) = 1"""


def trailing(table: str, keys: str, order: str, value: str, rows: int, out: str) -> str:
    frame = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    exact = f"cast(sum(cast({value} as decimal(18,2))) {frame} as double)"
    return f"SELECT *, {exact} / nullif(count({value}) {frame}, 0) AS {out} FROM {table}"


SYMBOL = (
    "concat('HE', case split_part(contract_month, '-', 2) when 'Jan' then 'G' when 'Feb' then 'G' when 'Mar' then 'J' "
    "when 'Apr' then 'J' when 'May' then 'K' when 'Jun' then 'M' when 'Jul' then 'N' when 'Aug' then 'Q' "
    "when 'Sep' then 'V' when 'Oct' then 'V' when 'Nov' then 'Z' when 'Dec' then 'Z' end, split_part(contract_month, '-', 1))"
)
FALLBACK = "split_part(contract_month, '-', 2) IN ('Jan', 'Mar', 'Sep', 'Nov')"
MONTH = (
    "cast(case split_part(contract_month, '-', 2) when 'Jan' then 1 when 'Feb' then 2 when 'Mar' then 3 when 'Apr' then 4 "
    "when 'May' then 5 when 'Jun' then 6 when 'Jul' then 7 when 'Aug' then 8 when 'Sep' then 9 when 'Oct' then 10 "
    "when 'Nov' then 11 when 'Dec' then 12 end as bigint)"
)
YEAR = "(2000 + cast(split_part(contract_month, '-', 1) as bigint))"
PROTECTED = "('Lean Hog Put Option', 'LRP Policy')"


def pnl(instrument: str, price: str, premium: str, market: str, other: str) -> str:
    return (
        f"case when {market} is null then null when {instrument} = 'Lean Hog Futures' then {price} - {market} "
        f"when {instrument} in {PROTECTED} then greatest(0::double, {price} - {premium} - {market}) - {premium} else {other} end"
    )


DERIVED["life"] = (
    ["nursery", "flow", "hedging"],
    f"""
    SELECT n.*, f.* EXCLUDE (pig_group_id),
      n.received_head - f.head_to_finisher AS nursery_mortality,
      {even("cast(n.received_head - f.head_to_finisher as double) / n.received_head * 100", 1)} AS nursery_mortality_pct,
      datediff('day', n.placement_date, f.finisher_entry_date) AS days_in_nursery,
      {even("f.weight_at_finisher_entry - n.avg_weight_in_lb", 1)} AS nursery_weight_gain_lb,
      f.finisher_entry_date + 112 AS est_market_date,
      h.* EXCLUDE (pig_group_id),
      case when h.instrument_type in {PROTECTED} then h.strike_or_futures_price_cwt - h.option_or_lrp_premium_cwt
           else h.strike_or_futures_price_cwt end AS effective_floor_cwt,
      f.head_to_finisher - h.head_covered AS unhedged_head,
      {even("(1 - h.coverage_percent) * 100", 1)} AS unhedged_pct
    FROM nursery n
    LEFT JOIN (
      SELECT pig_group_id, movement_date AS finisher_entry_date, to_site AS finisher_site, to_barn AS finisher_barn,
             head_moved AS head_to_finisher, avg_weight_lb AS weight_at_finisher_entry
      FROM flow WHERE to_site LIKE '%Finisher%'
      QUALIFY row_number() OVER (PARTITION BY pig_group_id ORDER BY movement_date DESC, move_id DESC) = 1
    ) f USING (pig_group_id)
    LEFT JOIN hedging h USING (pig_group_id)""",
)
DERIVED["marks"] = (
    ["endpoint"],
    """
    SELECT symbol, close AS current_market_cwt, trading_day AS market_date FROM endpoint WHERE commodity = 'HE'
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trading_day DESC, close DESC) = 1""",
)
DERIVED["pnl"] = (
    ["hedging", "marks"],
    f"""
    SELECT *, pnl_per_cwt * 2.10 AS pnl_per_head, pnl_per_cwt * 2.10 * head_covered AS total_pnl FROM (
      SELECT h.pig_group_id, h.symbol, h.contract_month, h.instrument_type, h.strike_or_futures_price_cwt AS hedge_price_cwt,
        h.option_or_lrp_premium_cwt AS premium_cwt, m.current_market_cwt, m.market_date, h.head_covered,
        h.coverage_percent AS coverage_pct,
        {pnl("h.instrument_type", "h.strike_or_futures_price_cwt", "h.option_or_lrp_premium_cwt", "m.current_market_cwt", "0::double")} AS pnl_per_cwt
      FROM (SELECT *, {SYMBOL} AS symbol FROM hedging) h LEFT JOIN marks m ON h.symbol = m.symbol)""",
)


def _daily(commodity: str, name: str) -> str:
    return (
        f"SELECT trading_day AS date, close AS {name} FROM endpoint WHERE commodity = '{commodity}' "
        "QUALIFY row_number() OVER (PARTITION BY trading_day "
        "ORDER BY right(symbol, 2), position(left(right(symbol, 3), 1) IN 'FGHJKMNQUVXZ'), close) = 1"
    )


DERIVED["corn"] = (["endpoint"], _daily("ZC", "corn_cents_bu"))
DERIVED["meal"] = (["endpoint"], _daily("ZM", "sbm"))
DERIVED["front"] = (["endpoint"], _daily("HE", "he_front_close"))
DERIVED["feed"] = (
    ["corn", "meal"],
    f"""
    SELECT *, feed_cost_usd_ton * 0.4::double AS feed_cost_per_head FROM (
      SELECT *, 0.75 * corn_usd_ton + 0.20 * sbm_usd_ton AS feed_cost_usd_ton FROM (
        SELECT c.date, c.corn_cents_bu, m.sbm_usd_ton, c.corn_cents_bu / 100 * (2000::double / 56) AS corn_usd_ton
        FROM corn c LEFT JOIN ({nearest("corn", "meal", "date", "date", "sbm", "sbm_usd_ton", 3)}) m ON c.date = m.date))""",
)
DERIVED["idx"] = (
    ["indexes"],
    "SELECT report_date, amount AS v FROM indexes WHERE purchase_type = 'Prod. Sold Negotiated'",
)
DERIVED["dashboard"] = (
    ["front", "national", "idx"],
    f"""
    SELECT f.date, f.he_front_close, n.national_cash, i.cme_index, n.national_cash - f.he_front_close AS basis
    FROM front f
    LEFT JOIN ({nearest("front", "national", "date", "report_date", "wtd_avg", "national_cash", 3)}) n ON f.date = n.date
    LEFT JOIN ({nearest("front", "idx", "date", "report_date", "v", "cme_index", 3)}) i ON f.date = i.date""",
)
DERIVED["combos"] = (
    ["packer"],
    f"""
    SELECT packer, contract_type, {mean("eval_price_cwt")} AS avg_eval_cwt, {mean("matrix_premium_cwt")} AS avg_matrix,
      {mean("sort_loss_cwt")} AS avg_sort_loss, {mean("vob_cwt")} AS avg_vob, count(settlement_id) AS loads,
      cast(sum(delivered_head) as bigint) AS total_head
    FROM packer GROUP BY packer, contract_type""",
)
DERIVED["ranking"] = (
    ["combos"],
    f"""
    SELECT *, row_number() OVER (ORDER BY avg_eval_cwt DESC, packer, contract_type) AS rank,
      {even("(avg_eval_cwt - (SELECT min(avg_eval_cwt) FROM combos)) * 2.10", 2)} AS advantage_per_head
    FROM combos""",
)
DERIVED["margins"] = (
    ["life", "pnl", "feed"],
    f"""
    SELECT *,
      case when est_margin is null then 'unknown' when est_margin > 30 then 'strong' when est_margin > 15 then 'on_track'
           when est_margin > 5 then 'watch' when est_margin > 0 then 'tight' else 'at_risk' end AS status_key,
      case when est_margin is null then '⚪ N/A' else concat(
           case when est_margin > 30 then '✅ Strong' when est_margin > 15 then '✅ On track'
                when est_margin > 5 then '🟡 Watch' when est_margin > 0 then '🟡 Tight' else '🔴 At risk' end,
           case when coverage_percent < 0.50 then ' ⚠️' else '' end) end AS status_label
    FROM (
      SELECT *, {even("blend * 2.10 - cost", 2)} AS est_margin FROM (
        SELECT l.*, p.current_market_cwt, p.pnl_per_cwt, p.pnl_per_head, p.total_pnl, p.symbol AS hedge_symbol,
          case when exists (SELECT 1 FROM feed) then (SELECT feed_cost_per_head FROM feed ORDER BY date DESC LIMIT 1) else 73.57::double end + 72.0::double AS cost,
          case when p.current_market_cwt is null or p.current_market_cwt = 0 then null
            when l.instrument_type = 'Lean Hog Futures'
              then l.strike_or_futures_price_cwt * l.coverage_percent + p.current_market_cwt * (1 - l.coverage_percent)
            when l.instrument_type in {PROTECTED}
              then (greatest(p.current_market_cwt, l.strike_or_futures_price_cwt) - l.option_or_lrp_premium_cwt) * l.coverage_percent
                   + p.current_market_cwt * (1 - l.coverage_percent)
            else p.current_market_cwt end AS blend
        FROM life l LEFT JOIN pnl p USING (pig_group_id)))""",
)
DERIVED["stays"] = (
    ["barn_env"],
    """
    SELECT barn AS pig_group_id, site, barn, min(date) AS placement_date, min(date) + 10 AS finisher_entry_date,
      max(date) AS est_market_date FROM barn_env GROUP BY site, barn""",
)
DERIVED["barn_days"] = (
    ["barn_env"],
    f"""
    SELECT site, barn, date, {total("water_usage_gallons")} AS water_usage_gallons, max(avg_temperature_f) AS avg_temperature_f
    FROM barn_env GROUP BY site, barn, date""",
)
DERIVED["disease"] = (
    [],
    f"""
    SELECT month(o_orderdate) AS m, {mean("o_totalprice")} / 50000 AS level FROM orders GROUP BY 1""",
)

# Lifecycle and joins -----------------------------------------------------------------

ORACLES["q_lifecycle"] = sql("life", "SELECT * FROM life")
ORACLES["q_nursery_hedging"] = sql(
    "nursery hedging",
    f"""
    SELECT n.*, h.* EXCLUDE (pig_group_id), h.buy_sell AS health_status_hedge,
      n.received_head - h.head_covered AS unhedged_head, {even("(1 - h.coverage_percent) * 100", 1)} AS unhedged_pct,
      case when h.instrument_type in {PROTECTED} then h.strike_or_futures_price_cwt - h.option_or_lrp_premium_cwt
           else h.strike_or_futures_price_cwt end AS effective_floor_cwt
    FROM nursery n LEFT JOIN hedging h USING (pig_group_id)""",
)
ORACLES["q_asof_nearest"] = f"""
    WITH o AS (SELECT o_orderkey, cast(o_orderdate as date) AS order_date FROM orders),
    p AS (SELECT cast(l_shipdate as date) AS ship_date, l_extendedprice FROM lineitem)
    SELECT o.o_orderkey, o.order_date, m.price, m.price_date, m.price_off AS days_offset
    FROM o LEFT JOIN ({nearest("o", "p", "order_date", "ship_date", "l_extendedprice", "price", 5)}) m ON o.order_date = m.order_date"""
ORACLES["q_asof_chain"] = sql("dashboard", "SELECT * FROM dashboard")
ORACLES["q_packer_basis"] = sql(
    "packer national idx western",
    f"""
    SELECT p.*, p.base_price_cwt + p.matrix_premium_cwt + p.sort_loss_cwt + p.vob_cwt AS eval_check,
      n.national_cash_cwt, p.base_price_cwt - n.national_cash_cwt AS basis_vs_national,
      w.western_cb_cash_cwt, p.base_price_cwt - w.western_cb_cash_cwt AS basis_vs_western_cb,
      i.cme_index_value, p.base_price_cwt - i.cme_index_value AS basis_vs_cme_index
    FROM packer p
    LEFT JOIN ({nearest("packer", "national", "kill_date", "report_date", "wtd_avg", "national_cash_cwt", 2)}) n USING (kill_date)
    LEFT JOIN ({nearest("packer", "western", "kill_date", "report_date", "wtd_avg", "western_cb_cash_cwt", 2)}) w USING (kill_date)
    LEFT JOIN ({nearest("packer", "idx", "kill_date", "report_date", "v", "cme_index_value", 2)}) i USING (kill_date)""".replace(
        "SELECT p.*,", "SELECT p.settlement_id, p.line, p.packer, p.contract_type, p.kill_date, p.delivered_head, p.base_price_cwt, "
        "p.matrix_premium_cwt, p.sort_loss_cwt, p.vob_cwt, p.eval_price_cwt,"
    ),
)
ORACLES["q_asof_keyed"] = """
    WITH o AS (SELECT o_orderkey AS orderkey, cast(o_orderdate as date) AS order_date FROM orders),
    l AS (SELECT l_orderkey AS orderkey, cast(l_shipdate as date) AS ship_date, l_linenumber, l_extendedprice FROM lineitem)
    SELECT o.orderkey, o.order_date, cast(m.l_linenumber as bigint) AS l_linenumber, m.l_extendedprice,
      m.ship_date AS matched_date, abs(datediff('day', o.order_date, m.ship_date)) AS days_offset
    FROM o LEFT JOIN (
      SELECT o.orderkey, l.ship_date, l.l_linenumber, l.l_extendedprice
      FROM o JOIN l ON o.orderkey = l.orderkey AND l.ship_date BETWEEN o.order_date - 400 AND o.order_date + 400
      QUALIFY row_number() OVER (PARTITION BY o.orderkey
        ORDER BY abs(datediff('day', o.order_date, l.ship_date)), l.ship_date, l.l_linenumber, l.l_extendedprice) = 1
    ) m ON o.orderkey = m.orderkey"""
DERIVED["positions"] = (["hedging"], f"SELECT *, {SYMBOL} AS symbol, {FALLBACK} AS symbol_is_fallback FROM hedging")
DERIVED["hog_closes"] = (["endpoint"], "SELECT * FROM endpoint WHERE commodity = 'HE'")
ORACLES["q_hedge_entry_price"] = sql(
    "positions hog_closes",
    f"""
    SELECT p.pig_group_id, p.symbol AS lookup_symbol, p.symbol_is_fallback, p.trade_date, m.c AS market_close_at_trade,
      m.c_date AS actual_trade_day, m.c_off AS days_offset
    FROM positions p LEFT JOIN ({nearest("positions", "hog_closes", "trade_date", "trading_day", "close", "c", 5, "symbol")}) m
      ON p.symbol = m.symbol AND p.trade_date = m.trade_date""",
)
ORACLES["q_hedge_entry_bar"] = sql(
    "positions futures",
    """
    SELECT p.pig_group_id, p.symbol AS lookup_symbol, f.time AS ohlcv_date, f.open, f.high, f.low, f.close, f.volume, f.open_interest
    FROM positions p LEFT JOIN (
      SELECT p.pig_group_id, f.* FROM positions p JOIN futures f
        ON p.symbol = f.symbol AND f.time BETWEEN p.trade_date - 3 AND p.trade_date + 3
      QUALIFY row_number() OVER (PARTITION BY p.pig_group_id ORDER BY abs(datediff('day', p.trade_date, f.time)), f.time,
        f.open, f.high, f.low, f.close, f.volume NULLS FIRST, f.open_interest NULLS FIRST) = 1
    ) f USING (pig_group_id)""",
)


def _phase(phase: str, low: str, high: str) -> str:
    on = f"e.site = s.site AND e.barn = s.barn AND e.date BETWEEN s.{low} AND s.{high}"
    return f"""
      SELECT s.pig_group_id, count(e.barn) AS {phase}_env_days, {mean("e.avg_temperature_f")} AS {phase}_avg_temp_f,
        {mean("e.avg_humidity_pct")} AS {phase}_avg_humidity, {mean("e.water_usage_gallons")} AS {phase}_avg_water,
        count(*) FILTER (e.avg_temperature_f < 40) AS {phase}_temp_alerts
      FROM stays s LEFT JOIN barn_env e ON {on} GROUP BY s.pig_group_id"""


ORACLES["q_interval_stats"] = sql(
    "stays barn_env",
    f"""
    SELECT * FROM ({_phase("nursery", "placement_date", "finisher_entry_date")})
    JOIN ({_phase("finisher", "finisher_entry_date", "est_market_date")}) USING (pig_group_id)""",
)
ORACLES["q_range_window"] = sql(
    "nursery farrowing",
    f"""
    , d AS (SELECT DISTINCT placement_date FROM nursery WHERE pig_source = 'Internal Sow Farm'),
    w AS (
      SELECT d.placement_date, cast(floor(count(*) / 3) as bigint) AS farrowing_weeks_matched,
        cast(sum(weaned_pigs) as bigint) AS total_weaned_in_window,
        cast(sum(pre_wean_mortality_head) as double) / nullif(cast(sum(live_born) as double), 0) * 100 AS avg_prewean_mortality_pct,
        {mean("avg_wean_weight_lb")} AS avg_wean_weight_lb,
        string_agg(DISTINCT sow_farm, ', ' ORDER BY sow_farm) AS farms_in_window
      FROM d JOIN farrowing f ON f.week_start BETWEEN d.placement_date - 14 AND d.placement_date GROUP BY d.placement_date)
    SELECT n.pig_group_id, w.* EXCLUDE (placement_date) FROM nursery n JOIN w USING (placement_date)
    WHERE n.pig_source = 'Internal Sow Farm'""",
)
ORACLES["q_range_global"] = sql(
    "stays weather",
    f"""
    SELECT s.pig_group_id, s.placement_date, s.est_market_date, {mean("w.outdoor_high_f", 3)} AS avg_high,
      {mean("w.outdoor_low_f", 3)} AS avg_low, max(w.peak_wind_gust_mph) AS max_gust, {mean("w.avg_wind_mph", 3)} AS avg_wind
    FROM stays s LEFT JOIN weather w ON w.date BETWEEN s.placement_date AND s.est_market_date
    GROUP BY s.pig_group_id, s.placement_date, s.est_market_date""",
)
ORACLES["q_nearest_value"] = """
    SELECT c.c_nationkey::bigint AS nation, c.c_custkey, c.c_acctbal, s.s_suppkey, abs(s.s_acctbal - c.c_acctbal) AS price_diff
    FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey
    QUALIFY row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(s.s_acctbal - c.c_acctbal), s.s_suppkey) = 1"""
ORACLES["q_lrp_premiums"] = sql(
    "hedging lrp_quotes",
    f"""
    SELECT h.pig_group_id, q.per_head_premium AS lrp_market_premium_per_head, q.producer_premium_amount AS lrp_producer_premium,
      q.subsidy_percent AS lrp_subsidy_pct, q.cme_premium AS cme_equivalent_premium
    FROM hedging h JOIN lrp_quotes q ON q.commodity = 'CME LEAN HOGS' AND q.grouping_date = {YEAR} * 100 + {MONTH}
    WHERE h.instrument_type = 'LRP Policy'
    QUALIFY row_number() OVER (PARTITION BY h.pig_group_id ORDER BY abs(q.coverage_price - h.strike_or_futures_price_cwt), q.quote_id) = 1""",
)
ORACLES["q_composite_join"] = sql(
    "hedging lookup_cme",
    f"""
    , m AS (SELECT cast(grouping_date as bigint) AS g, strike, min(previous) AS previous FROM lookup_cme
            WHERE name = 'CME LEAN HOGS' GROUP BY 1, 2),
    p AS (SELECT *, {YEAR} * 100 + {MONTH} AS g, cast(round_even(strike_or_futures_price_cwt, 0) as bigint) AS strike
          FROM hedging WHERE instrument_type = 'Lean Hog Put Option')
    SELECT p.pig_group_id, p.g AS grouping_date, p.strike AS strike_int, m.previous AS market_premium_cwt,
      p.option_or_lrp_premium_cwt - m.previous AS premium_vs_market
    FROM p LEFT JOIN m ON p.g = m.g AND p.strike = m.strike""",
)
ORACLES["q_contract_months"] = sql(
    "positions",
    f"SELECT pig_group_id, contract_month, symbol, symbol_is_fallback, {YEAR} * 100 + {MONTH} AS yyyymm FROM positions",
)
ORACLES["q_latest_mark"] = sql("pnl", "SELECT * FROM pnl")
ORACLES["q_period_benchmark"] = sql(
    "hedging packer",
    f"""
    , m AS (SELECT year(kill_date) AS y, month(kill_date) AS mo, {mean("eval_price_cwt")} AS e, {mean("base_price_cwt")} AS b
            FROM packer GROUP BY 1, 2)
    SELECT h.pig_group_id, h.contract_month, h.instrument_type AS instrument, h.strike_or_futures_price_cwt AS hedge_price_cwt,
      h.option_or_lrp_premium_cwt AS premium_cwt, m.e AS packer_avg_eval_cwt, m.b AS packer_avg_base_cwt,
      {pnl("h.instrument_type", "h.strike_or_futures_price_cwt", "h.option_or_lrp_premium_cwt", "m.e", "null")} AS proxy_hedge_pnl_cwt,
      m.y is not null AS has_packer_data
    FROM hedging h LEFT JOIN m ON m.y = {YEAR} AND m.mo = {MONTH}""",
)
ORACLES["q_orphans"] = """
    SELECT o_orderkey AS orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
ORACLES["q_shared"] = """
    SELECT doc_id AS id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
ORACLES["q_overlap"] = """
    SELECT 'lines' AS dataset, count(*) FILTER (NOT hit) AS orphans, count(*) FILTER (hit) AS overlap
    FROM (SELECT DISTINCT l_orderkey, l_orderkey IN (SELECT o_orderkey FROM orders) AS hit FROM lineitem)
    UNION ALL
    SELECT 'documents', count(*) FILTER (NOT hit), count(*) FILTER (hit)
    FROM (SELECT DISTINCT doc_id, doc_id IN (SELECT o_orderkey FROM orders) AS hit FROM documents)"""
ORACLES["q_scalar_broadcast"] = f"""
    WITH r AS (SELECT n_name, {total("o_totalprice")} AS revenue
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    SELECT n_name, revenue, (SELECT min(revenue) FROM r) AS lowest, revenue - (SELECT min(revenue) FROM r) AS lead FROM r"""
ORACLES["q_month_offset"] = sql(
    "nursery disease",
    """
    SELECT *, case when delta > 3 then 'HIGH' when delta > 1.5 then 'MODERATE' when delta is not null then 'LOW' end AS risk FROM (
      SELECT n.pig_group_id, n.placement_date, a.level AS level_at_placement, b.level AS level_two_months_on, b.level - a.level AS delta
      FROM nursery n LEFT JOIN disease a ON a.m = month(n.placement_date)
      LEFT JOIN disease b ON b.m = least(month(n.placement_date) + 2, 12))""",
)
ORACLES["q_topk_per_group"] = """
    SELECT o_custkey, o_orderkey, cast(o_orderdate as date) AS order_date, c_nationkey::bigint AS c_nationkey,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY cast(o_orderdate as date) DESC, o_orderkey DESC) AS rn
    FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rn <= 5"""
ORACLES["q_recent_deliveries"] = sql(
    "nursery",
    """
    , log AS (SELECT concat('Nursery ', cast(o_custkey % 25 as string)) AS nursery_site, o_orderkey, cast(o_orderdate as date) AS order_date,
        row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY cast(o_orderdate as date) DESC, o_orderkey DESC) AS rn
      FROM orders QUALIFY rn <= 5)
    SELECT n.pig_group_id, n.nursery_site, log.o_orderkey, log.order_date, log.rn FROM nursery n JOIN log USING (nursery_site)""",
)
ORACLES["q_group_topk_pair"] = sql(
    "life ranking",
    """
    SELECT l.pig_group_id, l.head_to_finisher, r.rank, r.packer, r.contract_type, r.avg_eval_cwt, r.advantage_per_head,
      r.advantage_per_head * l.head_to_finisher AS savings
    FROM life l CROSS JOIN (SELECT * FROM ranking WHERE rank <= 3) r""",
)
ORACLES["q_inner_losing"] = sql(
    "life pnl",
    """
    SELECT l.pig_group_id, l.instrument_type, l.coverage_percent, p.hedge_price_cwt, p.current_market_cwt, p.pnl_per_head, p.total_pnl
    FROM life l JOIN pnl p USING (pig_group_id) WHERE p.pnl_per_head < 0""",
)


def _money(col: str) -> str:
    return f"coalesce(printf('$%+.2f', {even(col, 2)}), 'N/A')"


ORACLES["q_left_overview"] = sql(
    "margins",
    f"""
    SELECT pig_group_id AS "group", finisher_site AS site, head_to_finisher AS head, health_status AS health,
      instrument_type AS instrument,
      cast(cast(round_even(coverage_percent * 100, 0) as bigint) as string) || '%' AS coverage,
      {even("effective_floor_cwt", 2)} AS floor, {even("current_market_cwt", 2)} AS market,
      {_money("pnl_per_head")} AS hedge_pnl_per_head, {_money("est_margin")} AS margin_per_head,
      strftime(est_market_date, '%Y-%m-%d') AS est_market, status_label AS status
    FROM margins""",
)
ORACLES["q_locked_vs_current"] = sql(
    "life pnl",
    """
    SELECT l.pig_group_id, l.effective_floor_cwt AS locked, p.current_market_cwt AS current, p.pnl_per_head AS pnl
    FROM life l LEFT JOIN pnl p USING (pig_group_id)
    WHERE l.effective_floor_cwt IS NOT NULL AND p.current_market_cwt IS NOT NULL""",
)

# Aggregates ----------------------------------------------------------------------------

ORACLES["q_rank_combo"] = sql("ranking", "SELECT * FROM ranking")
ORACLES["q_first_last"] = """
    WITH l AS (SELECT cast(l_shipdate as date) AS ship_date, l_extendedprice,
      row_number() OVER (PARTITION BY cast(l_shipdate as date) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS a,
      row_number() OVER (PARTITION BY cast(l_shipdate as date) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS z
      FROM lineitem)
    SELECT ship_date, max(l_extendedprice) FILTER (a = 1) AS first_price, max(l_extendedprice) FILTER (z = 1) AS last_price
    FROM l GROUP BY ship_date"""
ORACLES["q_seasonal"] = sql(
    "endpoint",
    f"""
    SELECT month(trading_day) AS month, {mean("close")} AS avg_price, min(close) AS min_price, max(close) AS max_price,
      case when count(close) > 1 then sqrt(cast(count(close) * sum(u * u) - sum(u) * sum(u) as double) / (cast(count(close) as double) * (count(close) - 1))) / 100::double end AS std_price
    FROM (SELECT *, cast(round_even(close * 100, 0) as hugeint) AS u FROM endpoint) WHERE commodity = 'HE' GROUP BY 1""",
)
ORACLES["q_cost_benchmark"] = sql(
    "accounting",
    f"""
    SELECT site, production_phase, cost_category, cast(date_trunc('month', date) as date) AS month, {total("total_cost")} AS total_cost
    FROM accounting WHERE site IS NOT NULL GROUP BY ALL""",
)
ORACLES["q_cost_summary"] = sql(
    "accounting",
    f"""
    SELECT production_phase, cost_category, {mean("total_cost")} AS monthly_avg, {total("total_cost")} AS total,
      count(total_cost) AS n_records
    FROM accounting GROUP BY production_phase, cost_category""",
)
ATTENTION = "(coverage_percent < 0.55 OR est_margin < 30 OR health_status IN ('Positive', 'Monitored'))"
ORACLES["q_kpi"] = sql(
    "margins",
    f"""
    SELECT *, avg_margin * total_head AS total_profit FROM (
      SELECT count(*) AS groups, {mean("est_margin")} AS avg_margin, cast(sum(head_to_finisher) as bigint) AS total_head,
        count(*) FILTER (coverage_percent < 0.55) AS low_coverage, count(*) FILTER (est_margin < 30) AS tight_margin,
        count(*) FILTER ({ATTENTION}) AS needs_attention
      FROM margins)""",
)
ORACLES["q_unhedged"] = sql(
    "life",
    """
    SELECT pig_group_id, head_to_finisher, unhedged_head, unhedged_pct, instrument_type, coverage_percent, est_market_date
    FROM life WHERE unhedged_pct > 20""",
)
ORACLES["q_exposure"] = sql(
    "life",
    """
    SELECT count(*) AS groups, cast(sum(unhedged_head) as bigint) AS exposed,
      (SELECT concat('PG-', pig_group_id) FROM life WHERE unhedged_pct > 20 AND unhedged_head IS NOT NULL
       ORDER BY unhedged_head DESC, concat('PG-', pig_group_id) LIMIT 1) AS most_exposed
    FROM life WHERE unhedged_pct > 20""",
)
ORACLES["q_total_deaths"] = sql(
    "mortality", "SELECT pig_group_id, cast(sum(deaths) as bigint) AS total_deaths FROM mortality GROUP BY pig_group_id"
)
ORACLES["q_ratio_of_sums"] = sql(
    "farrowing",
    """
    SELECT sow_farm, cast(sum(pre_wean_mortality_head) as double) / nullif(cast(sum(live_born) as double), 0) * 100 AS mortality_pct
    FROM farrowing GROUP BY sow_farm""",
)

# Timelines -----------------------------------------------------------------------------


ORACLES["q_alert"] = f"""
    SELECT user_id, event_id, value, trailing_avg, (1 - value / nullif(trailing_avg, 0)) * 100 AS drop_pct
    FROM ({trailing("events", "user_id", "ts, event_id", "value", 14, "trailing_avg")})
    WHERE value < trailing_avg * 0.85 AND trailing_avg > 0"""
ORACLES["q_alert_topk"] = sql(
    "barn_days",
    f"""
    SELECT site, barn, date, water_usage_gallons, avg14, avg_temperature_f,
      {half_up("(1 - water_usage_gallons / nullif(avg14, 0)) * 100", 1)} AS drop_pct
    FROM ({trailing("barn_days", "site, barn", "date", "water_usage_gallons", 14, "avg14")})
    WHERE water_usage_gallons < avg14 * 0.85 AND avg14 > 0 ORDER BY date DESC, site, barn LIMIT 5""",
)
ORACLES["q_water_alerts"] = sql(
    "barn_days",
    f"""
    SELECT site, barn, date, avg14, {half_up("(1 - water_usage_gallons / nullif(avg14, 0)) * 100", 1)} AS drop_pct
    FROM ({trailing("barn_days", "site, barn", "date", "water_usage_gallons", 7, "avg14")})
    WHERE water_usage_gallons < avg14 * 0.85""",
)
ORACLES["q_running"] = """
    SELECT user_id, event_id, value,
      cast(sum(cast(value as decimal(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) as double) AS running_total
    FROM events"""
ORACLES["q_weekly_deaths"] = sql(
    "mortality",
    f"""
    SELECT *, start_head - cumulative_deaths AS head_remaining,
      {even("deaths / nullif(start_head - cumulative_deaths + deaths, 0) * 100", 2)} AS weekly_mortality_pct
    FROM (SELECT *, cast(sum(deaths) OVER (PARTITION BY pig_group_id ORDER BY week_number) as bigint) AS cumulative_deaths FROM mortality)""",
)
ORACLES["q_latest_n"] = sql("dashboard", "SELECT date, he_front_close, national_cash FROM dashboard ORDER BY date DESC LIMIT 60")
ORACLES["q_feed_history"] = sql("feed", "SELECT date, corn_cents_bu, feed_cost_per_head FROM feed ORDER BY date DESC LIMIT 60")
ORACLES["q_market_context"] = sql("dashboard", "SELECT * FROM dashboard ORDER BY date DESC LIMIT 30")

# Lookups and predicates ----------------------------------------------------------------

ORACLES["q_point_lookup"] = f"""
    SELECT event_id AS day_in_finisher, value AS actual_feed_per_head_lb, value * 2 AS expected_feed_per_head_lb
    FROM events WHERE user_id = {POINT_USER}"""
ORACLES["q_treatments"] = sql(
    "treatment_logs",
    f"SELECT * EXCLUDE (pig_group_id) FROM treatment_logs WHERE pig_group_id = {POINT_USER}",
)
_SUMMARY = (
    "l.pig_group_id, l.nursery_site, l.finisher_site, l.finisher_barn, l.received_head, l.head_to_finisher, "
    "l.nursery_mortality_pct, l.days_in_nursery, l.est_market_date, l.health_status, l.instrument_type, l.coverage_percent, "
    "l.head_covered, l.effective_floor_cwt, l.unhedged_head, l.contract_month"
)
_PNL = "p.current_market_cwt, p.pnl_per_cwt, p.pnl_per_head, p.total_pnl"
ORACLES["q_group_summary"] = sql(
    "life pnl", f"SELECT {_SUMMARY}, {_PNL} FROM life l LEFT JOIN pnl p USING (pig_group_id) WHERE l.pig_group_id = {POINT_USER}"
)
ORACLES["q_all_groups"] = sql(
    "life pnl",
    f"""
    SELECT l.pig_group_id, l.finisher_site, l.head_to_finisher, l.instrument_type, l.coverage_percent, l.effective_floor_cwt,
      l.unhedged_pct, l.health_status, l.est_market_date, {_PNL}
    FROM life l LEFT JOIN pnl p USING (pig_group_id)""",
)
ORACLES["q_packer_for_group"] = sql(
    "life ranking",
    f"""
    SELECT l.pig_group_id, l.head_to_finisher, r.rank, r.packer, r.contract_type, r.avg_eval_cwt, r.advantage_per_head,
      r.advantage_per_head * l.head_to_finisher AS savings
    FROM life l CROSS JOIN (SELECT * FROM ranking WHERE rank <= 3) r WHERE l.pig_group_id = {POINT_USER}""",
)
ORACLES["q_attention"] = sql(
    "margins", f"SELECT pig_group_id, coverage_percent, est_margin, health_status, status_key FROM margins WHERE {ATTENTION}"
)

# Cleaning ------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ORACLES["q_clean_text"] = sql(
    "raw_rows",
    'SELECT "Order Key" AS order_key, '
    + ", ".join(f"{_STRIP.format(chr(34) + c + chr(34))} AS {n}" for c, n in [("Order-Date", "order_date"), ("Pct%", "pctpct"), ("Priority", "priority")])
    + " FROM raw_rows",
)
_DATE = (
    "coalesce(cast(try_strptime(trim(\"Order-Date\"), '%Y-%m-%d %H:%M:%S.%f') as date), "
    "cast(try_strptime(trim(\"Order-Date\"), '%Y-%m-%d') as date), cast(try_strptime(trim(\"Order-Date\"), '%m/%d/%Y') as date))"
)
_TOTAL = "try_cast(replace(\"Total$\", ',', '') as double)"
_COMPACT = "cast(try_strptime(cast(\"Compact\" as string), '%Y%m%d') as date)"
ORACLES["q_clean_types"] = sql(
    "raw_rows",
    f"""
    SELECT "Order Key" AS order_key, {_DATE} AS order_date, {_COMPACT} AS compact, {_TOTAL} AS total,
      try_cast(trim("Pct%") as double) AS pct
    FROM raw_rows""",
)
ORACLES["q_flags_clip"] = """
    SELECT l_orderkey, cast(l_linenumber as bigint) AS l_linenumber, l_extendedprice,
      case l_returnflag when 'A' then 'usd/cwt' when 'N' then 'cents/bushel' end AS price_unit,
      l_tax > 0 AND l_discount < 0.03 AS is_small,
      case when l_tax > 0 then greatest(least(l_discount, 0.08), 0.02) end AS clipped
    FROM lineitem"""
ORACLES["q_clip_counts"] = """
    SELECT count(*) FILTER (l_discount < 0.02) AS below, count(*) FILTER (l_discount > 0.08) AS above FROM lineitem"""
ORACLES["q_drop_nulls_const"] = sql(
    "raw_rows",
    f"""
    SELECT "Order Key" AS order_key, {_DATE} AS order_date, {_COMPACT} AS compact, {_TOTAL} AS totalusd, trim("Pct%") AS pctpct
    FROM raw_rows WHERE "Total$" IS NOT NULL""",
)
ORACLES["q_rename"] = sql(
    "raw_rows",
    """
    SELECT "Order Key" AS order_key, trim("Order-Date") AS order_date, "Compact" AS compact, trim("Total$") AS totalusd, trim("Pct%") AS share,
      trim("Priority") AS order_priority, "Constant" AS constant FROM raw_rows""",
)
ORACLES["q_generic"] = sql(
    "raw_rows",
    f"""
    SELECT "Order Key" AS order_key, {_DATE} AS order_date, "Compact" AS compact, trim("Total$") AS totalusd, trim("Pct%") AS pctpct,
      trim("Priority") AS priority, "Constant" AS constant FROM raw_rows""",
)
ORACLES["q_union"] = """
    SELECT c_custkey, c_mktsegment, lower(c_mktsegment) AS source FROM customer WHERE c_mktsegment IS NOT NULL"""

# Market formulas and scenarios -----------------------------------------------------------

ORACLES["q_feed_cost"] = sql("feed", "SELECT * FROM feed")
ORACLES["q_margin"] = sql(
    "margins", "SELECT pig_group_id, instrument_type, current_market_cwt, est_margin, status_key, status_label FROM margins"
)
ORACLES["q_premium_compare"] = sql(
    "lrp_quotes",
    f"""
    SELECT *, {half_up("cme_put_cost_cwt - lrp_cost_cwt", 2)} AS savings FROM (
      SELECT commodity, coverage_level_percent, coverage_price, {half_up("per_head_premium / 2.10", 2)} AS lrp_cost_cwt,
        cme_premium AS cme_put_cost_cwt, endorsement_length
      FROM lrp_quotes WHERE commodity = 'CME LEAN HOGS' AND coverage_level_percent >= 0.90
      ORDER BY coverage_level_percent DESC, coverage_price, endorsement_length LIMIT 10)""",
)
DERIVED["moved"] = (
    ["pnl"],
    """
    SELECT *, scenario_pnl_cwt * 2.10 AS scenario_pnl_head, scenario_pnl_cwt * 2.10 * head_covered AS scenario_total_pnl FROM (
      SELECT *, case when instrument_type = 'Lean Hog Futures' then hedge_price_cwt - scenario_market
          when scenario_market is null then 0 - premium_cwt
          else greatest(0::double, hedge_price_cwt - premium_cwt - scenario_market) - premium_cwt end AS scenario_pnl_cwt
      FROM (SELECT p.*, d.delta_cwt, p.current_market_cwt + d.delta_cwt AS scenario_market
            FROM pnl p CROSS JOIN (SELECT unnest([-10.0, -5.0, 5.0, 10.0])::double AS delta_cwt) d))""",
)
ORACLES["q_scenario_price"] = sql(
    "moved",
    """
    SELECT *, total_after - total_before AS total_delta FROM (
      SELECT delta_cwt, cast(sum(cast(round_even(total_pnl * 100, 0) as bigint)) as bigint) AS total_before,
        cast(sum(cast(round_even(scenario_total_pnl * 100, 0) as bigint)) as bigint) AS total_after,
        count(*) FILTER (scenario_pnl_head > 0) AS n_positive, count(*) FILTER (scenario_pnl_head < 0) AS n_negative, count(*) AS n
      FROM moved GROUP BY delta_cwt)""",
)
ORACLES["q_scenario_rows"] = sql(
    "moved",
    """
    SELECT pig_group_id, delta_cwt, scenario_market, scenario_pnl_cwt, scenario_pnl_head, scenario_total_pnl
    FROM moved WHERE delta_cwt = -5""",
)
ORACLES["q_scenario_cost"] = sql(
    "feed",
    f"""
    SELECT current_corn_cents, scenario_corn_cents, {even("feed_cost_per_head", 2)} AS current_feed_per_head,
      {even("scenario", 2)} AS scenario_feed_per_head, {even("scenario - feed_cost_per_head", 2)} AS delta_per_head FROM (
      SELECT f.corn_cents_bu AS current_corn_cents, c AS scenario_corn_cents, f.feed_cost_per_head,
        (0.75 * (c / 100 * (2000::double / 56)) + 0.20 * f.sbm_usd_ton) * 0.4::double AS scenario
      FROM (SELECT * FROM feed ORDER BY date DESC LIMIT 1) f CROSS JOIN (SELECT unnest([300.0, 500.0, 800.0])::double AS c))""",
)
ORACLES["q_scenario_hedge"] = sql(
    "life",
    f"""
    SELECT pig_group_id, additional_pct, {even("coverage_percent * 100", 1)} AS current_coverage_pct,
      {even("target * 100", 1)} AS new_coverage_pct, head_covered AS current_head_covered, new_head_covered,
      new_head_covered - head_covered AS additional_head,
      cast(floor((new_head_covered - head_covered) / 400) as bigint) AS additional_contracts,
      head_to_finisher - new_head_covered AS unhedged_after
    FROM (SELECT *, cast(trunc(head_to_finisher * target) as bigint) AS new_head_covered FROM (
      SELECT l.*, a AS additional_pct, least(l.coverage_percent + a / 100, 1::double) AS target
      FROM life l CROSS JOIN (SELECT unnest([10.0, 20.0, 50.0])::double AS a)
      WHERE l.head_to_finisher IS NOT NULL AND l.head_covered IS NOT NULL))""",
)
ORACLES["q_recommend"] = sql(
    "pnl ranking",
    """
    SELECT p.*, r.packer, r.contract_type, r.advantage_per_head
    FROM (SELECT pig_group_id, coverage_pct, current_market_cwt FROM pnl WHERE coverage_pct < 0.55 ORDER BY coverage_pct, pig_group_id LIMIT 1) p
    CROSS JOIN (SELECT * FROM ranking WHERE rank = 1) r""",
)
ORACLES["q_insight"] = sql(
    "pnl ranking feed barn_days",
    f"""
    SELECT * FROM (SELECT 'strongest' AS finding, cast(pig_group_id as string) AS subject, pnl_per_head AS value FROM pnl
      WHERE pnl_per_head IS NOT NULL ORDER BY pnl_per_head DESC, pig_group_id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'weakest', cast(pig_group_id as string), pnl_per_head FROM pnl
      WHERE pnl_per_head IS NOT NULL ORDER BY pnl_per_head, pig_group_id LIMIT 1)
    UNION ALL SELECT 'low_coverage', cast(pig_group_id as string), coverage_pct FROM pnl WHERE coverage_pct < 0.55
    UNION ALL SELECT 'low_coverage_groups', coalesce(string_agg(DISTINCT cast(pig_group_id as string), ', ' ORDER BY cast(pig_group_id as string)), ''), cast(count(*) as double)
      FROM pnl WHERE coverage_pct < 0.55
    UNION ALL SELECT 'best_packer', concat(packer, ' ', contract_type), advantage_per_head FROM ranking WHERE rank = 1
    UNION ALL SELECT * FROM (SELECT 'feed_cost', cast(date as string), feed_cost_per_head FROM feed ORDER BY date DESC LIMIT 1)
    UNION ALL SELECT 'barn_alerts', 'water', cast(count(*) as double)
      FROM ({trailing("barn_days", "site, barn", "date", "water_usage_gallons", 14, "avg14")})
      WHERE water_usage_gallons < avg14 * 0.85 AND avg14 > 0""",
)

# Quality ---------------------------------------------------------------------------------

_RAW_COLUMNS = ["Order Key", "Order-Date", "Compact", "Total$", "Pct%", "Priority", "mostlyNull", "Constant"]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DATED = r"^\s*(\d{4}-\d{1,2}-\d{1,2}( 00:00:00\.000)?|\d{1,2}/\d{1,2}/\d{4})\s*$"


def _profiled(column: str) -> str:
    return f"""
      SELECT '{column}' AS "column", count(*) AS n_rows, count(v) AS n_values,
        avg(case when v is null then null when regexp_matches(v, '{_NUMBER}') then 1.0 else 0.0 end) AS numeric_rate,
        avg(case when v is null then null when contains(v, '/') or contains(v, '-') then 1.0 else 0.0 end) AS mark_rate,
        avg(case when v is null then null when regexp_matches(v, '{_DATED}') then 1.0 else 0.0 end) AS date_rate,
        avg(length(v)) AS len, count(DISTINCT v) AS n_distinct
      FROM (SELECT cast("{column}" as string) AS v FROM raw_rows)"""


ORACLES["q_profile"] = sql(
    "raw_rows",
    f"""
    SELECT "column", n_rows, n_values, numeric_rate,
      case when n_values = 0 then 'unknown' when numeric_rate > 0.8 then 'numeric'
        when mark_rate > 0.5 and len > 6 and date_rate > 0.8 then 'date'
        when n_distinct <= 10 and n_values > 5 then 'category' else 'string' end AS type,
      (n_rows - n_values) / nullif(n_rows, 0) AS null_rate
    FROM ({" UNION ALL ".join(_profiled(c) for c in _RAW_COLUMNS)})""",
)
ORACLES["q_distinct_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
)
_RATES = [f'(count(*) - count("{c}"))::double / count(*)' for c in _RAW_COLUMNS]
ORACLES["q_null_rate"] = sql("raw_rows", f"SELECT ({' + '.join(_RATES)}) / {len(_RATES)} AS mean_null_rate FROM raw_rows")
ORACLES["q_map"] = sql(
    "packer",
    """
    SELECT kill_date AS "Kill_Date", packer AS "Packer", contract_type AS "Contract_Type", delivered_head AS "Delivered_Head",
      base_price_cwt AS "Base_Price_CWT", matrix_premium_cwt AS "Matrix_Premium_CWT", sort_loss_cwt AS "Sort_Loss_CWT"
    FROM packer""",
)
_CHECKS = [
    ("o_orderkey", "required", "o_orderkey IS NULL"),
    ("o_orderkey", "below_minimum", "o_orderkey < 1"),
    ("o_totalprice", "below_minimum", "o_totalprice < 10000"),
    ("o_totalprice", "above_maximum", "o_totalprice > 400000"),
    ("o_orderstatus", "unexpected_value", "o_orderstatus NOT IN ('F', 'O')"),
    ("o_orderpriority", "required", "o_orderpriority IS NULL"),
    ("o_orderpriority", "pattern", "NOT regexp_matches(o_orderpriority, '^[1-4]-')"),
    ("mostlyNull", "required", '"mostlyNull" IS NULL'),
    ("Order-Date", "not_a_date", f'"Order-Date" IS NOT NULL AND {_DATE} IS NULL'),
]
_PER_CHECK = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS rule, count(*) FILTER ({p}) AS n_bad, count(*) AS n_rows FROM ruled" for c, r, p in _CHECKS
)
ORACLES["q_validate"] = sql(
    "raw_rows",
    f""", ruled AS (SELECT o.*, r.* FROM orders o JOIN raw_rows r ON o.o_orderkey = r."Order Key")
    SELECT *, n_bad / n_rows AS bad_rate FROM ({_PER_CHECK})""",
)
_BROKEN = ", ".join(f"case when {p} then '{c}:{r}' end" for c, r, p in _CHECKS if c.startswith("o_"))
ORACLES["q_validate_rows"] = f"""
    SELECT * FROM (SELECT o_orderkey, concat_ws(', ', {_BROKEN}) AS broken_rules FROM orders) WHERE broken_rules <> ''"""
ORACLES["q_unexpected_values"] = """
    SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type"""
ORACLES["q_reconcile"] = sql(
    "nursery flow",
    """
    , m AS (SELECT pig_group_id, head_moved FROM flow WHERE event = 'Transfer'
      QUALIFY row_number() OVER (PARTITION BY pig_group_id ORDER BY movement_date DESC, move_id DESC) = 1)
    SELECT n.pig_group_id, n.received_head, m.head_moved, n.received_head - m.head_moved AS difference,
      case when n.received_head > m.head_moved then (n.received_head - m.head_moved) / n.received_head * 100 end AS difference_pct,
      case when n.received_head < m.head_moved then 'issue' when n.received_head > m.head_moved then 'loss' else 'match' end AS finding
    FROM nursery n JOIN m USING (pig_group_id)""",
)
ORACLES["q_claims"] = """
    WITH RECURSIVE
    s AS (SELECT l_suppkey % 40 AS upload, l_partkey % 9 AS position, concat('f', (l_orderkey % 7) * (l_linenumber % 3)) AS target, count(*) % 20 / 20 AS score
      FROM lineitem GROUP BY 1, 2, 3),
    scores AS (SELECT upload, position, target, score + case when target = 'f0' then 0.5::double else 0::double end AS score FROM s),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY upload, position ORDER BY score DESC, target) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY upload, target ORDER BY score DESC, position) AS nth FROM best),
    losers AS (SELECT upload, position, row_number() OVER (PARTITION BY upload ORDER BY position) AS i FROM ranked WHERE nth > 1),
    taken AS (SELECT upload, list(target) AS gone FROM ranked WHERE nth = 1 GROUP BY upload),
    choices AS (SELECT upload, position, i, list({'score': -score, 'target': target}) AS wanted FROM losers JOIN scores USING (upload, position) WHERE score > 0.4 GROUP BY ALL),
    walk AS (
      SELECT upload, 0::BIGINT AS i, gone, NULL::BIGINT AS position, NULL::STRUCT(score DOUBLE, target VARCHAR) AS got FROM taken
      UNION ALL
      SELECT upload, i, case when got IS NULL then gone else list_append(gone, got.target) end, position, got FROM (
        SELECT w.upload, l.i, w.gone, l.position, list_min(list_filter(c.wanted, lambda x: NOT list_contains(w.gone, x.target))) AS got
        FROM walk w JOIN losers l ON l.upload = w.upload AND l.i = w.i + 1 LEFT JOIN choices c ON c.upload = l.upload AND c.i = l.i))
    SELECT upload, concat('c', position) AS "column", target, score, 'match' AS outcome FROM ranked WHERE nth = 1
    UNION ALL SELECT upload, concat('c', position), got.target, coalesce(-got.score, 0), case when got IS NULL then 'demoted' else 'rematch' end FROM walk WHERE i > 0"""
ORACLES["q_identity"] = sql(
    "packer farrowing futures accounting",
    """
    SELECT 'eval_price' AS "check", count(ok) AS n_checked, count(*) FILTER (NOT ok) AS n_violations FROM (SELECT
      abs(eval_price_cwt - (base_price_cwt + matrix_premium_cwt + sort_loss_cwt + vob_cwt)) <= 0.01 AS ok FROM packer)
    UNION ALL SELECT 'weaned', count(ok), count(*) FILTER (NOT ok) FROM (SELECT
      abs(live_born - (weaned_pigs + pre_wean_mortality_head)) <= 0 AS ok FROM farrowing)
    UNION ALL SELECT 'line_total', count(ok), count(*) FILTER (NOT ok) FROM (SELECT
      abs(l_extendedprice - l_quantity * round_even(l_extendedprice / l_quantity, 0)) <= 10 AS ok FROM lineitem)
    UNION ALL SELECT 'ohlc', count(ok), count(*) FILTER (NOT ok) FROM (SELECT
      low <= least(open, close) AND high >= greatest(open, close) AS ok FROM futures)
    UNION ALL SELECT 'total_cost', count(ok), count(*) FILTER (NOT ok) FROM (SELECT
      abs(total_cost - quantity * unit_cost) <= 0.01 AS ok FROM accounting)""",
)

# Routing and manifest ------------------------------------------------------------------


def has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def number(text: str, value: str, condition: str) -> str:
    """Last token of a text that is a number and meets a condition."""
    tokens = f"list_transform(string_split_regex(trim({text}), '\\s+'), lambda s: try_cast(s as double))"
    kept = f"list_filter({tokens}, lambda x: x IS NOT NULL AND ({condition}))"
    return f"list_transform({kept}, lambda x: {value})[-1]"


_FALL, _RISE = has("drop", "fall", "decline", "down"), has("rise", "rally", "up", "increase")
_INTENT = f"""
    case when g is not null and {has("packer", "ship", "route", "where")} then 'packer_for_group'
      when g is not null and {has("disease", "prrs", "ped", "health risk")} then 'disease_context'
      when g is not null and contains(q, 'hedge') and {has("add", "more", "increase")} then 'scenario_add_hedge'
      when g is not null then 'group_summary'
      when {has("what should", "recommend", "advice", "suggest", "what do i do")} then 'action_recommendation'
      when {has("what if", "scenario", "what happens")} and {has("corn", "feed")} then 'scenario_feed'
      when {has("what if", "scenario", "what happens")} and ({_FALL} or {_RISE}) then 'scenario_price'
      when {has("packer", "ship", "which packer")} then 'best_packer'
      when {has("lrp", "put option", "compare hedge", "insurance")} then 'hedge_comparison'
      when {has("barn", "water", "temperature", "alert")} then 'barn_alerts'
      when {has("feed cost", "corn price", "soybean")} then 'feed_cost'
      when {has("market", "futures", "price", "seasonal", "basis")} then 'market_context'
      when {has("losing", "loss", "worst", "risk", "underwater")} then 'losing_groups'
      when {has("unhedged", "exposure", "unprotected")} then 'unhedged_exposure'
      when {has("disease", "prrs", "ped")} then 'disease_context'
      else 'weekly_summary' end"""
_ROUTED = (
    "SELECT *, {intent} AS intent, upper(g) AS group_id FROM "
    "(SELECT *, list_min(regexp_extract_all(q, '\\bpg-\\d+\\b')) AS g FROM (SELECT *, lower(trim(text)) AS q FROM {source}))"
)
ORACLES["q_route"] = "SELECT conv_id, turn, intent, group_id FROM (" + _ROUTED.format(
    intent=_INTENT, source="(SELECT * FROM conversations WHERE role = 'user')"
) + ")"
ORACLES["q_params"] = sql(
    "questions",
    f"""
    SELECT event_id, intent, group_id,
      case when intent = 'scenario_price' then case
        when {_FALL} then coalesce({number("replace(replace(q, '$', ''), '-', '')", "-x", "x BETWEEN 1 AND 30")}, -5::double)
        else coalesce({number("replace(q, '$', '')", "x", "x BETWEEN 1 AND 30")}, 5::double) end end AS delta,
      case when intent = 'scenario_feed' then coalesce({number("replace(q, '$', '')", "case when x BETWEEN 3 AND 8 then x * 100 else x end",
        "x BETWEEN 3 AND 8 OR x BETWEEN 300 AND 800")}, 500::double) end AS corn_cents,
      case when intent = 'scenario_add_hedge' then coalesce({number("replace(q, '%', '')", "x", "x BETWEEN 1 AND 100")}, 20::double) end AS pct
    FROM ({_ROUTED.format(intent=_INTENT, source="questions")})""",
)
_COLUMNS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
ORACLES["q_manifest"] = " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS n_rows, cast({_COLUMNS[n]} as bigint) AS n_cols FROM {n}" for n in TABLES
)

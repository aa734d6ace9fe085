"""Domain tables shaped from the test tables.

Each binding is a row-wise projection, written once in SQL expressions both engines read,
so that a query and its oracle start from the same input. The operators themselves are
written twice: in the library and in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MONTH = (
    "case c_custkey % 12 when 0 then 'Jan' when 1 then 'Feb' when 2 then 'Mar' when 3 then 'Apr' "
    "when 4 then 'May' when 5 then 'Jun' when 6 then 'Jul' when 7 then 'Aug' when 8 then 'Sep' "
    "when 9 then 'Oct' when 10 then 'Nov' else 'Dec' end"
)
_LETTER = (
    "case l_suppkey % 8 when 0 then 'G' when 1 then 'J' when 2 then 'K' when 3 then 'M' "
    "when 4 then 'N' when 5 then 'Q' when 6 then 'V' else 'Z' end"
)
_COMMODITY = "case l_returnflag when 'A' then 'HE' when 'N' then 'ZC' else 'ZM' end"


def _cents(number: str, low: int, span: int) -> str:
    """Price of two decimals between low and low + span cents, derived from a number."""
    return f"cast({low} + cast(floor(abs({number})) as bigint) % {span} as double) / 100"


# name -> (source table, {column: expression}, row condition)
BINDINGS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "nursery": (
        "customer",
        {
            "pig_group_id": "c_custkey",
            "placement_date": "date '1995-01-01' + cast(c_custkey % 730 as int)",
            "nursery_site": "concat('Nursery ', cast(c_nationkey as string))",
            "nursery_barn": "c_mktsegment",
            "pig_source": "case when c_acctbal < 5000 then 'Internal Sow Farm' else 'External Supplier' end",
            "received_head": "cast(1500 + c_custkey % 997 as bigint)",
            "avg_weight_in_lb": "cast(100 + c_custkey % 60 as double) / 10",
            "health_status": "case c_custkey % 7 when 0 then 'Positive' when 1 then 'Monitored' else 'Negative' end",
        },
        None,
    ),
    "flow": (
        "orders",
        {
            "pig_group_id": "o_custkey",
            "movement_date": "cast(o_orderdate as date)",
            "move_id": "o_orderkey",
            "event": "case when o_orderstatus = 'P' then 'Placement' else 'Transfer' end",
            "to_site": "case when o_orderstatus = 'P' then 'Nursery North' else concat('Finisher ', o_orderstatus) end",
            "to_barn": "o_orderpriority",
            "head_moved": "cast(1400 + o_orderkey % 1009 as bigint)",
            "avg_weight_lb": "cast(400 + o_orderkey % 300 as double) / 10",
        },
        None,
    ),
    "hedging": (
        "customer",
        {
            # positions of one segment belong to groups that no other table has
            "pig_group_id": "case when c_mktsegment = 'FURNITURE' then c_custkey + 100000000 else c_custkey end",
            "instrument_type": (
                "case c_custkey % 4 when 0 then 'Lean Hog Futures' when 1 then 'Lean Hog Put Option' "
                "when 2 then 'LRP Policy' else 'Cash Contract' end"
            ),
            "buy_sell": "case when c_custkey % 4 = 0 then 'Sell' else 'Buy' end",
            "trade_date": "date '1995-06-01' + cast(c_custkey % 2000 as int)",
            "strike_or_futures_price_cwt": _cents("c_acctbal * 100", 6000, 4000),
            "option_or_lrp_premium_cwt": "cast(c_custkey % 500 as double) / 100",
            "contract_month": f"concat(case when c_custkey % 2 = 0 then '00' else '01' end, '-', {_MONTH})",
            "coverage_percent": "cast(c_custkey % 101 as double) / 100",
            "head_covered": "cast(c_custkey % 2000 as bigint)",
            "contracts": "cast(floor((c_custkey % 2000) / 400) as bigint)",
        },
        None,
    ),
    "endpoint": (
        "lineitem",
        {
            "commodity": _COMMODITY,
            "symbol": (
                f"concat({_COMMODITY}, {_LETTER}, case when l_linestatus = 'F' then '00' else '01' end)"
            ),
            "trading_day": "cast(l_shipdate as date)",
            "close": _cents("l_extendedprice", 5000, 5000),
        },
        None,
    ),
    "futures": (
        "lineitem",
        {
            "symbol": f"concat('HE', {_LETTER}, case when l_linestatus = 'F' then '00' else '01' end)",
            "time": "cast(l_shipdate as date)",
            "open": _cents("l_extendedprice", 5000, 5000),
            "high": _cents("l_extendedprice", 5100, 5000),
            "low": _cents("l_extendedprice", 4900, 5000),
            "close": _cents("l_extendedprice", 5050, 5000),
            "volume": "case when l_quantity > 25 then l_quantity end",
            "open_interest": "case when l_quantity > 40 then l_quantity * 10 end",
        },
        None,
    ),
    "national": (
        "orders",
        {"report_date": "cast(o_orderdate as date)", "wtd_avg": _cents("o_totalprice", 6000, 4000)},
        None,
    ),
    "western": (
        "orders",
        {"report_date": "cast(o_orderdate as date)", "wtd_avg": _cents("o_totalprice", 5500, 4000)},
        None,
    ),
    "indexes": (
        "orders",
        {
            "report_date": "cast(o_orderdate as date)",
            "purchase_type": "case when o_orderpriority = '2-HIGH' then 'Prod. Sold Negotiated' else 'Packer Owned' end",
            "amount": _cents("o_totalprice", 6500, 4000),
        },
        None,
    ),
    "packer": (
        "lineitem",
        {
            "settlement_id": "l_orderkey",
            "line": "l_linenumber",
            "packer": "concat('Packer ', cast(l_suppkey % 10 as string))",
            "contract_type": "case l_returnflag when 'A' then 'LEAN' when 'N' then 'NEGOTIATED' else 'CARCASS' end",
            "kill_date": "cast(l_shipdate as date)",
            "delivered_head": "cast(l_quantity as bigint)",
            "base_price_cwt": _cents("l_extendedprice", 6000, 3000),
            "matrix_premium_cwt": "l_discount * 10",
            "sort_loss_cwt": "(0 - l_tax) * 10",
            "vob_cwt": "l_quantity / 100",
            "eval_price_cwt": (
                "cast(6000 + cast(floor(l_extendedprice) as bigint) % 3000 + cast(l_quantity as bigint) as double) / 100"
            ),
        },
        None,
    ),
    "barn_env": (
        "events",
        {
            "date": "cast(ts as date)",
            "site": "concat('Site ', cast(user_id % 3 as string))",
            "barn": "user_id",
            "avg_temperature_f": "value",
            "avg_humidity_pct": "cast(event_id % 100 as double)",
            "water_usage_gallons": "value * 10",
            "event_type": "event_type",
        },
        None,
    ),
    "weather": (
        "events",
        {
            "date": "cast(ts as date)",
            "outdoor_high_f": "value",
            "outdoor_low_f": "value / 2",
            "peak_wind_gust_mph": "value",
            "avg_wind_mph": "cast(event_id % 30 as double)",
        },
        None,
    ),
    "farrowing": (
        "lineitem",
        {
            "week_start": "cast(l_shipdate as date)",
            "sow_farm": "concat('Farm ', l_returnflag)",
            "weaned_pigs": "cast(l_quantity as bigint)",
            "pre_wean_mortality_head": "cast(l_linenumber as bigint)",
            "live_born": "cast(l_quantity as bigint) + l_linenumber",
            "avg_wean_weight_lb": "l_tax * 100 + 10",
        },
        None,
    ),
    "accounting": (
        "orders",
        {
            "date": "cast(o_orderdate as date)",
            "site": "case when o_custkey % 10 = 0 then null else concat('Site ', cast(o_custkey % 3 as string)) end",
            "production_phase": "o_orderpriority",
            "cost_category": "o_orderstatus",
            "quantity": "cast(o_orderkey % 6 + 1 as double)",
            "unit_cost": "floor(o_totalprice / (o_orderkey % 6 + 1) * 100) / 100",
            "total_cost": "o_totalprice",
        },
        None,
    ),
    "lrp_quotes": (
        "part",
        {
            "quote_id": "p_partkey",
            "commodity": "case when p_size % 3 = 0 then 'FDR CATTLE' else 'CME LEAN HOGS' end",
            "coverage_level_percent": "cast(70 + p_size % 31 as double) / 100",
            "coverage_price": "cast(6000 + (p_partkey * 37) % 4000 as double) / 100",
            "per_head_premium": "cast(p_partkey % 1000 as double) / 50",
            "producer_premium_amount": "cast(p_partkey % 700 as double) / 40",
            "subsidy_percent": "cast(p_size as double) / 100",
            "cme_premium": "cast(p_partkey % 900 as double) / 100",
            "endorsement_length": "cast(13 + p_size as bigint)",
            "grouping_date": "200000 + 100 * (p_partkey % 2) + 1 + p_partkey % 11",
        },
        None,
    ),
    "lookup_cme": (
        "part",
        {
            "name": "case when p_size % 5 = 0 then 'CME CATTLE' else 'CME LEAN HOGS' end",
            "grouping_date": "cast(200000 + 100 * (p_partkey % 2) + 1 + p_partkey % 11 as string)",
            "strike": "60 + p_partkey % 41",
            "previous": "cast(p_partkey % 600 as double) / 100",
        },
        None,
    ),
    "consumption": (
        "events",
        {
            "pig_group_id": "user_id",
            "day_in_finisher": "event_id",
            "actual_feed_per_head_lb": "value",
            "expected_feed_per_head_lb": "value * 2",
        },
        None,
    ),
    "mortality": (
        "events",
        {
            "pig_group_id": "user_id",
            "week_number": "event_id",
            "deaths": "cast(floor(value) as bigint) % 10",
            "start_head": "cast(5000 as bigint)",
        },
        None,
    ),
    "treatment_logs": (
        "events",
        {
            "pig_group_id": "user_id",
            "date": "cast(ts as date)",
            "treatment_type": "event_type",
            "medication": "props",
            "dose": "concat(cast(event_id as string), ' g/ton')",
            "administered_by": "concat('Tech. ', cast(event_id % 9 as string))",
            "reason": "event_type",
            "head_treated": "cast(floor(value) as bigint)",
        },
        None,
    ),
    # Questions put together from the rows, so that every intent occurs.
    "questions": (
        "events",
        {
            "event_id": "event_id",
            "text": (
                "concat(case event_id % 17 "
                "when 0 then 'Tell me about PG-10' when 1 then 'Where should I ship pg-10' "
                "when 2 then 'PRRS risk for PG-10' when 3 then 'Add more hedge to pg-10' "
                "when 4 then 'What should I do ' when 5 then 'What if corn goes to $' "
                "when 6 then 'What if hogs drop $' when 7 then 'Scenario: hogs rally $' "
                "when 8 then 'Which packer is best ' when 9 then 'Compare hedge and LRP ' "
                "when 10 then 'Barn water ' when 11 then 'Feed cost ' when 12 then 'Futures basis ' "
                "when 13 then 'Groups underwater ' when 14 then 'Unprotected head ' when 15 then 'PED ' "
                "else 'How are we ' end, "
                "cast(10 + event_id % 12 as string), case event_id % 3 when 0 then '' when 1 then '%' else '?' end, "
                "' ', cast(cast(floor(value) as bigint) as string), ' ', event_type)"
            ),
        },
        None,
    ),
    # Values written the way raw files carry them.
    "raw_rows": (
        "orders",
        {
            "Order Key": "o_orderkey",
            "Order-Date": (
                "case o_orderkey % 4 when 0 then concat(cast(cast(o_orderdate as date) as string), ' 00:00:00.000') "
                "when 1 then concat(cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), '/', "
                "cast(year(o_orderdate) as string)) "
                "when 2 then concat('  ', cast(cast(o_orderdate as date) as string), ' ') else 'not a date' end"
            ),
            "Compact": "case when o_orderkey % 5 = 0 then 99999999 else year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) end",
            "Total$": (
                "case when o_orderkey % 6 = 0 then 'n.a.' else concat(cast(cast(floor(o_totalprice / 1000) as bigint) as string), ',', "
                "substring(cast(1000 + cast(floor(o_totalprice) as bigint) % 1000 as string), 2, 3)) end"
            ),
            "Pct%": "case when o_orderkey % 7 = 0 then ' ' else concat(' ', cast(o_orderkey % 100 as string)) end",
            "Priority": "concat('  ', o_orderpriority, ' ')",
            "mostlyNull": "case when o_totalprice < 20000 then o_orderstatus end",
            "Constant": "case when o_orderkey % 3 = 0 then 'same' end",
        },
        None,
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    source, columns, condition = BINDINGS[name]
    rows = table(spark, sf_dir, source)
    rows = rows.where(condition) if condition else rows
    return rows.selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


def cte(name: str) -> str:
    """A binding as a common table expression."""
    source, columns, condition = BINDINGS[name]
    body = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"{name} AS (SELECT {body} FROM {source}" + (f" WHERE {condition})" if condition else ")")

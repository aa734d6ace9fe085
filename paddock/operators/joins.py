"""Joins: as-of, nearest value, range statistics, latest mark, period benchmark, keys.

Broadcast marks are set only on tables the calendar bounds: one row per day or month after
aggregation. All other sides are left to the optimizer, which broadcasts a side when its
known size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.numeric import flag, from_units, mean, to_units
from paddock.operators.timeline import CHUNK, ranges


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the columns is null; group keys with nulls are left out this way."""
    return df.dropna(subset=list(columns))


def left_join_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left join where right columns that also exist on the left get a suffix."""
    taken = set(left.columns) - set(on)
    renamed = right.select(
        *[F.col(c).alias(c + suffix) if c in taken else F.col(c) for c in right.columns]
    )
    return left.join(renamed, on, "left")


def with_scalars(df: DataFrame, **values: DataFrame) -> DataFrame:
    """Adds the single value of one-row, one-column tables to every row, as scalar subqueries."""
    return df.withColumns({name: one.scalar() for name, one in values.items()})


def pair_with(df: DataFrame, choices: DataFrame, order: list[str], k: int, into: str = "choice") -> DataFrame:
    """Pairs every row with each of the first ``k`` rows of another table, such as a top-3
    ranking. The k rows travel as one array value and are exploded in place, without a join."""
    first = choices.select(F.struct(*order, *[c for c in choices.columns if c not in order]).alias("__c"))
    first = first.orderBy("__c").limit(k)
    listed = first.agg(F.sort_array(F.collect_list("__c"))).scalar()
    return df.withColumn("__list", listed).select(*df.columns, F.explode("__list").alias(into))


def first_by_key(
    df: DataFrame, keys: list[str], order: Sequence[str | Column], columns: dict[str, Column]
) -> DataFrame:
    """Row with the lowest ordering of each key (null keys are left out)."""
    return _edge_by_key(df, keys, order, columns, F.min_by)


def latest_by_key(
    df: DataFrame, keys: list[str], order: Sequence[str | Column], columns: dict[str, Column]
) -> DataFrame:
    """Row with the highest ordering of each key (null keys are left out). The whole row is
    taken, also where some of its columns are null. Combined map-side."""
    return _edge_by_key(df, keys, order, columns, F.max_by)


def first_and_last_by_key(
    df: DataFrame, keys: list[str], order: Sequence[str | Column], first: dict[str, Column], last: dict[str, Column]
) -> DataFrame:
    """Columns of the row with the lowest and of that with the highest ordering of each key, in one
    aggregate (null keys are left out)."""
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    payload = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()])
    place = F.struct(*order)
    both = rows.groupBy(*keys).agg(F.min_by(payload(first), place).alias("__first"), F.max_by(payload(last), place).alias("__last"))
    return both.select(*keys, "__first.*", "__last.*")


def _edge_by_key(df, keys, order, columns, pick) -> DataFrame:
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    payload = F.struct(*[c.alias(n) for n, c in columns.items()])
    best = rows.groupBy(*keys).agg(pick(payload, F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str,
    payload: list[str],
    *,
    by: Sequence[str] = (),
    tolerance_days: int = 5,
    right_order: Sequence[str] = (),
    matched_date: str | None = None,
    offset: str | None = None,
) -> DataFrame:
    """Left join to the right row nearest in time, at most ``tolerance_days`` away.

    Of two dates equally near the earlier one wins. The right side is reduced to one row
    per (by, date) first: the first by ``right_order``, or else the lowest payload.

    Time is cut into buckets as wide as the search window: a left date touches at most
    two of them, a right row lies in exactly one, so the equi-join on (by, bucket) meets
    at most two windows of dates. Only distinct left dates take part."""
    by = list(by)
    for side, column in ((left, on), (right, right_on)):
        if not isinstance(side.schema[column].dataType, T.DateType):
            raise TypeError(f"{column} must be a date: days are bounded, instants are not")
    width = 2 * tolerance_days + 1
    single = len(payload) == 1 and not right_order
    if single:
        picked = F.min(payload[0])
    else:
        picked = F.min_by(F.struct(*payload), F.struct(*(list(right_order) or payload)))
    days = (
        right.where(F.col(right_on).isNotNull())
        .groupBy(*by, F.col(right_on).alias("__rdate"))
        .agg(picked.alias("__payload"))
        .withColumn("__bucket", F.floor(F.unix_date("__rdate") / width))
    )
    low, high = (F.floor((F.unix_date(on) + s * tolerance_days) / width) for s in (-1, 1))
    probes = (
        left.where(F.col(on).isNotNull())
        .select(*by, on)
        .distinct()
        .withColumn("__bucket", F.explode(F.sequence(low, high)))
    )
    away = F.abs(F.datediff(F.col(on), F.col("__rdate")))
    found = (
        probes.join(days if by else F.broadcast(days), [*by, "__bucket"])
        .where(away <= tolerance_days)
        .groupBy(*by, on)
        .agg(F.min_by(F.struct("__payload", "__rdate", away.alias("__away")), F.struct(away, "__rdate")).alias("__hit"))
    )
    out = left.join(found if by else F.broadcast(found), [*by, on], "left")
    extra = [F.col("__hit.__payload" if single else f"__hit.__payload.{c}").alias(c) for c in payload]
    if matched_date:
        extra.append(F.col("__hit.__rdate").alias(matched_date))
    if offset:
        extra.append(F.col("__hit.__away").cast("bigint").alias(offset))
    return out.select(*left.columns, *extra)


def nearest_value(
    left: DataFrame,
    right: DataFrame,
    value: str,
    right_value: str,
    payload: list[str],
    *,
    by: list[str],
    key: str,
    difference: str = "price_diff",
    partitions: int | None = None,
) -> DataFrame:
    """Inner join to the right row of the same group whose value is nearest.

    On equal distance the lower ``key`` wins. Groups without right rows are left out.

    Distinct values of both sides are put on one axis per group, and a window finds the
    right value below and above each left value. The axis is cut into ranges; what lies in
    other ranges is carried over as the nearest one on each side. No pairs of a group are
    formed."""
    points = (
        not_null(right, [*by, right_value])
        .groupBy(*by, F.col(right_value).cast("double").alias("__v"))
        .agg(F.min_by(F.struct(key, *[c for c in payload if c != key]), key).alias("__p"))
        .select(*by, "__v", F.struct("__v", "__p").alias("__right"))
    )
    probes = not_null(left, [*by, value]).select(*by, F.col(value).cast("double").alias("__v")).distinct()
    axis = points.unionByName(probes, allowMissingColumns=True)

    # Both sides look back, one along the falling order: a frame that ends at the current
    # row grows row by row, one that starts there would be built anew for each row.
    def neighbours(rows: DataFrame, within: list[str]) -> DataFrame:
        line = Window.partitionBy(*within)
        frames = {"__lo": line.orderBy("__v"), "__hi": line.orderBy(F.desc("__v"))}
        seen = {n: F.last("__right", True).over(w.rangeBetween(Window.unboundedPreceding, 0)) for n, w in frames.items()}
        return rows.withColumns(seen).where(F.col("__right").isNull())

    chunked = ranges(axis, by, ["__v"], partitions)
    filled = F.when(F.col("__right").isNotNull(), F.col("__v"))
    edges = chunked.groupBy(*by, CHUNK).agg(
        F.max_by("__right", filled).alias("__top"), F.min_by("__right", filled).alias("__bottom")
    )
    line, earlier = Window.partitionBy(*by), (Window.unboundedPreceding, -1)
    carry = edges.select(
        *by,
        CHUNK,
        F.last("__top", True).over(line.orderBy(CHUNK).rowsBetween(*earlier)).alias("__below"),
        F.last("__bottom", True).over(line.orderBy(F.desc(CHUNK)).rowsBetween(*earlier)).alias("__above"),
    )
    near = (
        neighbours(chunked, [*by, CHUNK])
        .join(carry, [*by, CHUNK], "left")
        .withColumns({"__lo": F.coalesce("__lo", "__below"), "__hi": F.coalesce("__hi", "__above")})
    )

    gap = {s: F.abs(F.col(f"{s}.__v") - F.col("__v")) for s in ("__lo", "__hi")}
    choices = [
        F.when(F.col(s).isNotNull(), F.struct(gap[s].alias("d"), F.col(f"{s}.__p.{key}").alias("k"), F.col(f"{s}.__p").alias("p")))
        for s in ("__lo", "__hi")
    ]
    best = (
        near.withColumn("__best", F.array_min(F.array_compact(F.array(*choices))))
        .where(F.col("__best").isNotNull())
        .select(*by, F.col("__v").alias("__probe"), "__best")
    )
    return (
        left.withColumn("__probe", F.col(value).cast("double"))
        .join(best, [*by, "__probe"])
        .select(*left.columns, *[F.col(f"__best.p.{c}").alias(c) for c in payload], F.col("__best.d").alias(difference))
    )


TOP_LEVEL = 22  # blocks of 2 ** 22 days hold every date


def _cover(low: Column, high: Column) -> Column:
    """The days from low to high as at most two blocks of 2 ** level days a level: array of (level, at),
    where block `at` of a level holds the days whose number shifted right by the level is `at`."""
    low, high = F.unix_date(low).cast("bigint"), F.unix_date(high).cast("bigint") + 1
    block = lambda level, at: F.array(F.struct(level.alias("level"), at.alias("at")))
    none = F.array().cast("array<struct<level:int,at:bigint>>")

    def step(state: Column, level: Column) -> Column:
        odd_low, odd_high = state["low"] % 2 != 0, state["high"] % 2 != 0
        found = F.concat(state["found"], F.when(odd_low, block(level, state["low"])).otherwise(none), F.when(odd_high, block(level, state["high"] - 1)).otherwise(none))
        half = lambda c: F.shiftright(c, 1)
        inner = F.struct(
            half(state["low"] + odd_low.cast("bigint")).alias("low"), half(state["high"] - odd_high.cast("bigint")).alias("high"), found.alias("found")
        )
        return F.when(state["low"] < state["high"], inner).otherwise(state)

    start = F.struct(low.alias("low"), high.alias("high"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), start, step, lambda state: state["found"])


def _in_blocks(days: DataFrame, distinct: DataFrame, by: list[str], low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `days` at every level the longest span has, and the spans cut into their blocks."""
    longest = distinct.agg(F.coalesce(F.floor(F.log2(F.max(F.datediff(high, low)) + 1)).cast("int"), F.lit(0))).scalar()
    levels = days.withColumn("level", F.explode(F.sequence(F.lit(0), longest))).withColumn("at", F.expr("shiftright(cast(__day AS bigint), level)")).drop("__day")
    pieces = distinct.select(*by, low, high, F.inline(_cover(F.col(low), F.col(high))))
    return levels, pieces


def _range_sums(distinct: DataFrame, days: DataFrame, by: list[str], low: str, high: str, states: list[str]) -> DataFrame:
    """Sums of the day states inside each span, as differences of running totals read at its ends.

    Days and span ends lie on one line per key, which has a few rows a day of the calendar at most."""
    ends = distinct.select(*by, F.explode(F.array(F.date_sub(low, 1), F.col(high))).alias("__end")).distinct().select(*by, F.unix_date("__end").alias("__day"), F.lit(True).alias("__is_end"))
    line = days.select(*by, "__day", *states).unionByName(ends, allowMissingColumns=True)
    past = Window.partitionBy(*by).orderBy("__day", F.col("__is_end").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    read = line.withColumns({s: F.coalesce(F.sum(s).over(past), F.lit(0)) for s in states}).where("__is_end").drop("__is_end")

    def at(end: str, day: Column) -> tuple[DataFrame, list]:
        named = read.select(*[F.col(c).alias(f"{end}_{c}") for c in (*by, "__day")], *[F.col(s).alias(f"{s}_{end}") for s in states])
        return named, [F.col(c) == F.col(f"{end}_{c}") for c in by] + [F.unix_date(day) == F.col(f"{end}___day")]

    before, before_on = at("before", F.date_sub(low, 1))
    last, last_on = at("last", F.col(high))
    joined = distinct.join(before, before_on).join(last, last_on)
    return joined.select(*by, low, high, *[(F.col(f"{s}_last") - F.col(f"{s}_before")).alias(s) for s in states])


def range_stats(
    spans: DataFrame,
    series: DataFrame,
    low: str,
    high: str,
    on: str,
    stats: dict[str, tuple],
    *,
    by: Sequence[str] = (),
    how: str = "left",
) -> DataFrame:
    """Statistics of the series rows dated inside each span, both ends included.

    ``stats`` maps a name to (kind, column) or (kind, column, scale); kinds are count,
    count_if, sum, avg, min, max and names (sorted distinct texts). A span without rows keeps
    counts of 0 and null for the rest; ``how="inner"`` leaves it out. ``by`` adds equality keys,
    such as site and barn.

    The series is first reduced to one row per (by, day), and equal spans are measured once.
    Counts and sums are differences of running totals at the span's ends, in whole units where a
    scale is given. Without one, infinite and missing numbers make the sums they lie in NaN. Lowest and
    highest values and names are kept by blocks of a power of two of days, of which a span has at
    most two a level. So the work does not grow with the days of a span."""
    by = list(by)
    spec = {n: (s[0], s[1], s[2] if len(s) > 2 else None) for n, s in stats.items()}
    dated = series.where(F.col(on).isNotNull()).withColumn("__day", F.unix_date(on))
    sums: dict[str, Column] = {"__rows": F.count(F.lit(1))}
    edges: dict[str, Column] = {}
    for n, (kind, value, scale) in spec.items():
        if kind == "count":
            sums[f"{n}__n"] = F.count(value)
        elif kind == "count_if":
            sums[f"{n}__n"] = F.count_if(flag(value))
        elif kind in ("sum", "avg"):
            units = to_units(value, scale)
            whole = F.lit(True) if scale is not None else F.abs(units) < float("inf")
            sums |= {f"{n}__s": F.sum(F.when(whole, units)), f"{n}__n": F.count(value), f"{n}__w": F.count_if(~whole)}
        elif kind in ("min", "max"):
            edges[n] = getattr(F, kind)(value)
        elif kind != "names":
            raise ValueError(f"unknown statistic {kind}")
    days = dated.groupBy(*by, "__day").agg(*[c.alias(n) for n, c in (sums | edges).items()])
    distinct = spans.where(F.col(low) <= F.col(high)).select(*by, low, high).distinct()
    keys = [*by, low, high]
    measured = _range_sums(distinct, days, by, low, high, list(sums)).where("__rows > 0")
    if edges:
        levels, pieces = _in_blocks(days.select(*by, "__day", *edges), distinct, by, low, high)
        pick = {n: getattr(F, spec[n][0]) for n in edges}
        blocks = levels.groupBy(*by, "level", "at").agg(*[f(n).alias(n) for n, f in pick.items()])
        found = pieces.join(blocks, [*by, "level", "at"]).groupBy(*keys).agg(*[f(n).alias(n) for n, f in pick.items()])
        measured = measured.join(found, keys, "left")
    for n, (kind, value, _) in spec.items():
        if kind == "names":
            levels, pieces = _in_blocks(dated.select(*by, "__day", value.alias(n)).where(F.col(n).isNotNull()).distinct(), distinct, by, low, high)
            each = pieces.join(levels.distinct(), [*by, "level", "at"]).select(*keys, n).distinct()
            text = F.array_join(F.sort_array(F.collect_list(n)), ", ")
            measured = measured.join(each.groupBy(*keys).agg(text.alias(n)), keys, "left")

    def result(n: str) -> Column:
        kind, _, scale = spec[n]
        if kind.startswith("count"):
            return F.coalesce(f"{n}__n", F.lit(0)).alias(n)
        if kind in ("sum", "avg"):
            known = F.when(F.col(f"{n}__n") > 0, F.when(F.col(f"{n}__w") > 0, F.lit(float("nan"))).otherwise(from_units(F.col(f"{n}__s"), scale)))
            return (known if kind == "sum" else known / F.nullif(f"{n}__n", F.lit(0))).alias(n)
        return F.when(F.col("__rows") > 0, F.coalesce(n, F.lit(""))).alias(n) if kind == "names" else F.col(n)

    return spans.join(measured, keys, how).select(*spans.columns, *[result(n) for n in spec])


def period_benchmark(
    positions: DataFrame,
    facts: DataFrame,
    year: Column,
    month: Column,
    date: str,
    means: dict[str, str],
    *,
    has_data: str,
    scale: int | None = None,
) -> DataFrame:
    """Left join of each position to the means of its target month. The facts are
    aggregated to one row per month first, so the join side is as long as the calendar."""
    monthly = (
        facts.where(F.col(date).isNotNull())
        .groupBy(F.year(date).alias("__year"), F.month(date).alias("__month"))
        .agg(*[mean(F.col(c), scale).alias(n) for n, c in means.items()], F.count(F.lit(1)).alias("__n"))
    )
    keyed = positions.withColumn("__year", year).withColumn("__month", month)
    return (
        keyed.join(F.broadcast(monthly), ["__year", "__month"], "left")
        .withColumn(has_data, F.col("__n").isNotNull())
        .drop("__year", "__month", "__n")
    )


def month_offset_lookup(
    df: DataFrame,
    index: DataFrame,
    date: str,
    month: str,
    level: str,
    *,
    months_ahead: int = 2,
    high_above: float = 3.0,
    moderate_above: float = 1.5,
) -> DataFrame:
    """Level of a monthly index at a date and some months later (December at most), the
    rise between them and its risk band. The index is reduced to one level per calendar
    month, the lowest, so twelve rows are looked up."""
    months = index.where(F.col(month).between(1, 12)).groupBy(F.col(month).cast("int").alias("__m")).agg(F.min(level).alias("__level"))
    start = F.broadcast(months.select(F.col("__m").alias("__m0"), F.col("__level").alias("start_level")))
    end = F.broadcast(months.select(F.col("__m").alias("__m1"), F.col("__level").alias("end_level")))
    rise = F.col("end_level") - F.col("start_level")
    band = (
        F.when(rise > high_above, "HIGH").when(rise > moderate_above, "MODERATE").when(rise.isNotNull(), "LOW")
    )
    return (
        df.withColumn("__m0", F.month(date))
        .withColumn("__m1", F.least(F.month(date) + months_ahead, F.lit(12)))
        .join(start, "__m0", "left")
        .join(end, "__m1", "left")
        .withColumn("delta", rise)
        .withColumn("risk", band)
        .drop("__m0", "__m1")
    )


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of the child table that the parent does not have."""
    keys = child.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(parent.select(key), key, "left_anti")


def shared_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys both tables have."""
    keys = child.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(parent.select(key), key, "left_semi")


def key_overlap(parent: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Per child table: number of keys the parent does not have, and of keys it shares.

    Each table sets one bit per key. One aggregate by key, combined map-side, tells which
    tables have it; nothing is joined. A long has bits for 62 child tables."""
    if len(children) > 62:
        raise ValueError("at most 62 child tables in one call")

    def tagged(table: DataFrame, bit: int) -> DataFrame:
        return table.where(F.col(key).isNotNull()).select(key, F.lit(1 << bit).cast("bigint").alias("__bit"))

    tags = tagged(parent, 0)
    for i, child in enumerate(children.values()):
        tags = tags.unionByName(tagged(child, i + 1))
    seen = tags.groupBy(key).agg(F.bit_or("__bit").alias("__bits"))

    def has(bit: int) -> Column:
        return F.col("__bits").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    counts = [
        F.struct(
            F.lit(name).alias("dataset"),
            F.count_if(has(i + 1) & ~has(0)).alias("orphans"),
            F.count_if(has(i + 1) & has(0)).alias("overlap"),
        )
        for i, name in enumerate(children)
    ]
    return seen.agg(F.array(*counts).alias("__c")).select(F.explode("__c").alias("c")).select("c.*")

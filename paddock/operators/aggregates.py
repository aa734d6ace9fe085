"""Grouped aggregates: rankings, seasonal profiles, cost benchmarks, key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.market import CWT_PER_HEAD
from paddock.functions.numeric import mean, round_even, to_units, total
from paddock.operators.joins import not_null, with_scalars
from paddock.operators.timeline import global_rank


def measures(
    df: DataFrame,
    by: list[str],
    *,
    means: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    counts: dict[str, str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Means, sums and counts of values that are not null, per group with no null key."""
    aggs = [mean(F.col(c), scale).alias(n) for n, c in (means or {}).items()]
    aggs += [total(F.col(c), scale).alias(n) for n, c in (sums or {}).items()]
    aggs += [F.count(F.col(c)).alias(n) for n, c in (counts or {}).items()]
    return not_null(df, by).groupBy(*by).agg(*aggs)


def ranked_advantage(
    df: DataFrame,
    score: str,
    ties: list[str],
    *,
    factor: float = CWT_PER_HEAD,
    digits: int | None = 2,
    rank: str = "rank",
    advantage: str = "advantage_per_head",
) -> DataFrame:
    """Rank by falling score and the lead over the lowest score, per head."""
    ranked = global_rank(df, [F.desc_nulls_last(score), *[F.asc(t) for t in ties]], rank)
    lowest = with_scalars(ranked, __lowest=ranked.agg(F.min(score)))
    lead = (F.col(score) - F.col("__lowest")) * factor
    return lowest.withColumn(advantage, lead if digits is None else round_even(lead, digits)).drop("__lowest")


def deviation(value: Column, scale: int | None = None) -> Column:
    """Sample standard deviation, null below two values. With a scale it comes from whole units, as
    exact decimals, so it has the same digits for any order and partitioning."""
    if scale is None:
        return F.stddev_samp(value)
    units = to_units(value, scale).cast("decimal(19,0)")
    n, exact = F.count(value), lambda c: c.cast("decimal(38,0)")
    squares = exact(F.sum(exact(units * units)))
    first = exact(F.sum(units))
    spread = exact(exact(n) * squares) - exact(first * first)
    return F.when(n > 1, F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1).cast("double"))) / float(10**scale))


def seasonal_profile(
    df: DataFrame, date: str, value: str, *, with_std: bool = False, scale: int | None = None
) -> DataFrame:
    """Mean, lowest and highest value per calendar month over all years."""
    aggs = [
        mean(F.col(value), scale).alias("avg_price"),
        F.min(value).alias("min_price"),
        F.max(value).alias("max_price"),
    ]
    if with_std:
        aggs.append(deviation(F.col(value), scale).alias("std_price"))
    return df.where(F.col(date).isNotNull()).groupBy(F.month(date).alias("month")).agg(*aggs)


def monthly_totals(df: DataFrame, by: list[str], date: str, value: str, *, scale: int | None = None) -> DataFrame:
    """Sum per group and calendar month; the month is given by its first day."""
    dated = df.withColumn("month", F.trunc(date, "MM"))
    return measures(dated, [*by, "month"], sums={value: value}, scale=scale)


def cost_summary(df: DataFrame, by: list[str], value: str, *, scale: int | None = None) -> DataFrame:
    """Mean per record, sum and count per group, largest sums first inside the first key."""
    summary = measures(
        df, by, means={"monthly_avg": value}, sums={"total": value}, counts={"n_records": value}, scale=scale
    )
    return summary.orderBy(F.asc(by[0]), F.desc("total"), *by[1:])


def ratio_of_sums(top: Column, bottom: Column) -> Column:
    """Sum over sum in percent, null when the lower sum is zero."""
    return F.sum(top) / F.nullif(F.sum(bottom), F.lit(0)) * 100


def key_figures(
    df: DataFrame,
    *,
    margin: str,
    head: str,
    coverage: str,
    attention: Column,
    low_coverage: float = 0.55,
    tight_margin: float = 30,
    scale: int | None = None,
) -> DataFrame:
    """One row of operation figures: mean margin, heads, profit and groups to look at."""
    figures = df.agg(
        F.count(F.lit(1)).alias("groups"),
        mean(F.col(margin), scale).alias("avg_margin"),
        F.sum(F.col(head).cast("bigint")).alias("total_head"),
        F.count_if(F.col(coverage) < low_coverage).alias("low_coverage"),
        F.count_if(F.col(margin) < tight_margin).alias("tight_margin"),
        F.count_if(attention).alias("needs_attention"),
    )
    return figures.withColumn("total_profit", F.col("avg_margin") * F.col("total_head"))


def exposure(df: DataFrame, key: str, amount: str) -> DataFrame:
    """One row: number of exposed groups, their heads and the most exposed one."""
    return df.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(amount).alias("exposed"),
        # of equal amounts the lowest key, whatever its type
        F.min_by(key, F.struct(F.col(amount).isNull(), -F.col(amount), F.col(key))).alias("most_exposed"),
    )


def scenario_totals(df: DataFrame, before: str, after: str, per_unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums before and after a scenario, the change, and how many positions gain or lose."""
    totals = df.groupBy(*by).agg(
        F.sum(before).alias("total_before"),
        F.sum(after).alias("total_after"),
        F.count_if(F.col(per_unit) > 0).alias("n_positive"),
        F.count_if(F.col(per_unit) < 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n"),
    )
    return totals.withColumn("total_delta", F.col("total_after") - F.col("total_before"))


def mean_null_rate(df: DataFrame) -> DataFrame:
    """One row: the null rate of each column, averaged over the columns."""
    rates = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns]
    return df.agg((sum(rates[1:], rates[0]) / len(rates)).alias("mean_null_rate"))

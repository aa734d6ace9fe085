"""Ordered operators over long per-key timelines.

A plain window puts all rows of a key into one task. Here the rows are range-partitioned by key
and order first, whatever the types of the ordering, and written to the checkpoint folder once.
A long key then lies in several ranges, and what a range needs from the ranges before it (the
last rows of a frame, a running sum) is carried over as a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.numeric import flag, from_units, to_units
from paddock.session import ensure_checkpoint_dir

CHUNK = "__chunk"


def ranges(df: DataFrame, keys: list[str], order: list, partitions: int | None = None) -> DataFrame:
    """The rows with the number of their range by (keys, order), grown in that order. Rows equal
    in both lie in one range; the sample that cuts the ranges follows the rows, so a key with a
    third of them gets a third of the ranges."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id()).checkpoint()


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def _frame_mean(value: str, scale: int | None, frame) -> Column:
    units = to_units(F.col(value), scale)
    return from_units(F.sum(units).over(frame), scale) / F.nullif(F.count(value).over(frame), F.lit(0))


def trailing_mean(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    *,
    rows: int = 14,
    name: str = "trailing_avg",
    scale: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Mean of the ``rows`` rows before the current one in its key; the current row is
    not part of the frame, and the first row of a key gets null.

    The frame counts rows, not days. ``order`` must be a total order inside a key."""
    chunked = ranges(_with_keys(df, keys), keys, order, partitions)
    last_first = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order])
    tails = (
        chunked.select(*keys, CHUNK, *order, value)
        .withColumn("__rn", F.row_number().over(last_first))
        .where(F.col("__rn") <= rows)
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("__tail"))
    )
    # Every chunk holds at least one row, so `rows` chunks back are enough for the frame.
    back = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-rows, -1)
    carried = (
        tails.withColumn("__carry", F.flatten(F.collect_list("__tail").over(back)))
        .select(*keys, CHUNK, F.explode(F.slice("__carry", F.greatest(F.size("__carry") - (rows - 1), F.lit(1)), rows)).alias("__r"))
        .select(*keys, CHUNK, "__r.*", F.lit(True).alias("__carried"))
    )
    both = chunked.withColumn("__carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(-rows, -1)
    return (
        both.withColumn(name, _frame_mean(value, scale, frame)).where(~F.col("__carried")).select(*df.columns, name)
    )


def drop_alerts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    *,
    below: float = 0.85,
    name: str = "trailing_avg",
    positive_only: bool = True,
    **options,
) -> DataFrame:
    """Rows whose value falls below a share of the trailing mean, with the drop in percent."""
    hit = F.col(value) < F.col(name) * below
    if positive_only:
        hit = hit & (F.col(name) > 0)
    drop_pct = (1 - F.col(value) / F.nullif(F.col(name), F.lit(0.0))) * 100
    return trailing_mean(df, keys, order, value, name=name, **options).where(hit).withColumn("drop_pct", drop_pct)


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    *,
    scale: int,
    name: str = "running_total",
    partitions: int | None = None,
) -> DataFrame:
    """Sum of the value from the first row of the key up to the current one.

    Values are summed as whole units of their last decimal (``scale``), so the result does not
    depend on where ranges begin."""
    units = to_units(F.col(value), scale)
    chunked = ranges(_with_keys(df, keys), keys, order, partitions)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy(*keys, CHUNK).agg(F.sum(units).alias("__sum"))
    offsets = sums.select(*keys, CHUNK, F.sum("__sum").over(earlier).alias("__offset"))
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(units).over(frame)
    before = F.col("__offset")
    running = F.when(inside.isNotNull() | before.isNotNull(), F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)))
    return chunked.join(offsets, [*keys, CHUNK], "left").withColumn(name, from_units(running, scale)).select(*df.columns, name)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of every key. Spark limits each key map-side before the
    shuffle, so a hot key arrives as k rows per map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def latest_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of an ordering, returned oldest first."""
    newest = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.orderBy(*order)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Position of every row in an ordering of the whole table, from 1.

    The table is range-partitioned by the ordering and checkpointed with the partition numbers;
    each partition is then numbered on top of the rows in the partitions before it, which is a
    table of one row per partition. The ordering must be total."""
    ranged = ranges(df, [], order, partitions)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(CHUNK)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(CHUNK, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    inside = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(offsets), CHUNK)
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop(CHUNK, "__inside", "__before")
    )


def best_claim(df: DataFrame, target: str, order: list[Column], keep: str = "is_winner") -> DataFrame:
    """Marks the best claimant of every target; the rest are demoted. Rows without a target claim
    nothing and do not meet in a window."""
    rank = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    claims = df.where(F.col(target).isNotNull()).withColumn(keep, flag(rank == 1))
    return claims.unionByName(df.where(F.col(target).isNull()).withColumn(keep, F.lit(False)))

"""One-to-one assignment of columns to fields for many tables at once.

Each column claims the field it scores best on. The surest claim on a field wins, the earlier column
on a tie. Columns that lost are matched once more among the fields nobody won, the earlier column
first. Both steps are rounds of aggregates over (table, column, field) rows, so neither a field
that every column claims nor a table with very many columns comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.session import ensure_checkpoint_dir

REMATCH_ABOVE = 0.4


def _proposals(scores: DataFrame) -> DataFrame:
    """The best field of every column: the highest score, of equal ones the first name."""
    best = F.min_by(F.struct("target", "score"), F.struct((-F.col("score")).alias("s"), "target")).alias("best")
    return scores.groupBy("table", "column", "position").agg(best).select("table", "column", "position", "best.*")


def _held(proposals: DataFrame, *order) -> DataFrame:
    """Of every proposed field the column it keeps."""
    return proposals.groupBy("table", "target").agg(F.min_by("column", F.struct(*order)).alias("keeps"))


def assign(
    scores: DataFrame, table: str, column: str, position: str, target: str, score: str, *, rematch_above: float = REMATCH_ABOVE
) -> DataFrame:
    """One row per column of every table: its field, the score and the outcome (match, rematch, demoted).

    ``scores`` has a row for each field a column may stand for; ``position`` orders the columns of a
    table and is unique in it. Rows with a null table, column, field or score claim nothing. The rematch is a
    deferred acceptance: columns propose to their best free field, a field keeps the earliest column, and
    those it turns away propose again, until none is turned away. Every field keeps one proposal a
    round, so there are at most as many rounds as fields in a table."""
    session = scores.sparkSession
    ensure_checkpoint_dir(session)
    names = {"table": table, "column": column, "position": position, "target": target, "score": score}
    rows = scores.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()]).dropna()
    first = _proposals(rows).checkpoint()
    sure = [(-F.col("score")).alias("s"), "position"]
    won = _held(first, *sure)
    matched = first.join(won, ["table", "target"]).withColumn("won", F.col("column") == F.col("keeps")).drop("keeps").checkpoint()
    losers = matched.where("NOT won").select("table", "column", "position")
    free = rows.where(F.col("score") > rematch_above).join(won.select("table", "target"), ["table", "target"], "left_anti")
    wanted = free.join(losers.select("table", "column"), ["table", "column"], "left_semi").checkpoint()
    while True:
        proposed = _proposals(wanted)
        placed = proposed.join(_held(proposed, "position"), ["table", "target"]).withColumn("kept", F.col("column") == F.col("keeps")).drop("keeps").checkpoint()
        refused = placed.where("NOT kept").select("table", "column", "target")
        if refused.isEmpty():
            break
        wanted = wanted.join(refused, ["table", "column", "target"], "left_anti").checkpoint()
    again = placed.select("table", "column", "target", "score")
    rest = losers.join(again, ["table", "column"], "left")
    columns = ["table", "column", "target", F.coalesce("score", F.lit(0.0)).alias("score")]
    out = matched.where("won").select(*columns, F.lit("match").alias("outcome"))
    out = out.unionByName(rest.select(*columns, F.when(F.col("target").isNull(), "demoted").otherwise("rematch").alias("outcome")))
    return out.select(F.col("table").alias(table), F.col("column").alias(column), F.col("target").alias(target), F.col("score").alias(score), "outcome")

"""Writers and the manifest of what was written."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def safe_name(name: str) -> str:
    """File or table name in lower case with one underscore between words."""
    return re.sub(r"\W+", "_", name).strip("_").lower()


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _entry(df: DataFrame, file: str, seen: Observation) -> dict:
    return {"file": file, "rows": seen.get["rows"], "cols": len(df.columns), "columns": df.columns}


def write_csv(df: DataFrame, folder: str, name: str) -> dict:
    """CSV folder with headers; the manifest entry is counted while writing."""
    file = f"{safe_name(name)}.csv"
    counted, seen = _counted(df)
    counted.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{folder.rstrip('/')}/{file}")
    return _entry(df, file, seen)


def write_parquet(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> dict:
    """Parquet table replaced as a whole; the manifest entry is counted while writing."""
    file = safe_name(name)
    counted, seen = _counted(df)
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder.rstrip('/')}/{file}")
    return _entry(df, file, seen)


def write_sorted_parquet(df: DataFrame, folder: str, name: str, order: Sequence[str], partitions: int) -> dict:
    """Parquet table laid out along an ordering, so that range filters skip row groups."""
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return write_parquet(ranged, folder, name)


def save_table(df: DataFrame, name: str) -> None:
    """Creates or replaces a catalog table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Manifest as one JSON document; it holds names and counts only."""
    text = json.dumps(manifest, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def table_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table as a DataFrame, counted on the executors."""
    facts = [
        t.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("dataset"), "n_rows", F.lit(len(t.columns)).cast("bigint").alias("n_cols")
        )
        for n, t in tables.items()
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out

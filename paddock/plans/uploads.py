"""From an unknown table to a standard one: profile, detect, map, validate, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from paddock.operators.aggregates import mean_null_rate
from paddock.operators.quality import (
    Match,
    conform,
    detect_schema,
    duplicate_targets,
    map_columns,
    profile,
    unmapped_required,
    validate,
)
from paddock.sources.schemas import UPLOAD_SCHEMAS
from paddock.sources.writers import safe_name, save_table


@dataclass(frozen=True)
class Upload:
    schema: str
    confidence: str
    scores: dict[str, float]
    mapping: list[Match]


def column_types(df: DataFrame) -> dict[str, str]:
    """Guessed type per column, in column order; one row per column reaches the driver."""
    found = {r["column"]: r["type"] for r in profile(df).select("column", "type").collect()}
    return {c: found[c] for c in df.columns}


def propose(df: DataFrame, schema: str | None = None) -> Upload:
    """Detected (or given) schema and the proposed mapping, to be edited before import."""
    types = column_types(df)
    best, sure, scores = detect_schema(types, UPLOAD_SCHEMAS)
    chosen = schema or best
    return Upload(chosen, sure, scores, map_columns(types, UPLOAD_SCHEMAS[chosen]))


def problems(upload: Upload) -> dict[str, list[str]]:
    """Targets claimed twice and required fields nothing is mapped to."""
    rules = UPLOAD_SCHEMAS[upload.schema]
    return {
        "duplicate_targets": duplicate_targets(upload.mapping),
        "unmapped_required": unmapped_required(upload.mapping, rules),
    }


def check(df: DataFrame, upload: Upload) -> tuple[DataFrame, DataFrame]:
    """The conformed table and the counts of broken rules. The rules are checked on the
    values as they came, so that a date that does not parse is counted."""
    rules = UPLOAD_SCHEMAS[upload.schema]
    renamed = df.select(*[df[f"`{m.column}`"].alias(m.target) for m in upload.mapping if m.target])
    return conform(df, upload.mapping, rules), validate(renamed, rules)


def summary(table: DataFrame, upload: Upload) -> dict:
    """Rows, mapped and possible columns and mean null rate of an import."""
    rate = mean_null_rate(table).first()["mean_null_rate"]
    return {
        "rows": table.count(),
        "columns_mapped": len(table.columns),
        "columns_possible": len(UPLOAD_SCHEMAS[upload.schema]),
        "null_rate": rate,
    }


def import_table(df: DataFrame, upload: Upload) -> str:
    """Writes the conformed table to the catalog and returns its name."""
    found = problems(upload)
    if any(found.values()):
        raise ValueError(f"mapping is not complete: {found}")
    name = f"imported_{safe_name(upload.schema)}"
    save_table(conform(df, upload.mapping, UPLOAD_SCHEMAS[upload.schema]), name)
    return name

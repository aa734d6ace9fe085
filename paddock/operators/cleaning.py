"""Table cleaning: column decisions taken from the data, and the spec runner."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.dates import parse_date, parse_yyyymmdd
from paddock.functions.numeric import clip, flag
from paddock.functions.text import comma_number, lookup, snake_columns, snake_name, strip_columns, to_number


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def null_and_constant_columns(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[dict[str, float], set[str]]:
    """Null share of each column and the columns with at most one distinct value.

    One aggregate over the table, with two values of state per column; the one row it
    returns is all the driver sees."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [
            F.count(_name(c)).alias(f"n{i}"),
            F.min(_name(c)).eqNullSafe(F.max(_name(c))).alias(f"same{i}"),
        ]
    row = df.agg(*aggs).first()
    rows = row["rows"]
    nulls = {c: (rows - row[f"n{i}"]) / rows if rows else 0.0 for i, c in enumerate(columns)}
    return nulls, {c for i, c in enumerate(columns) if row[f"same{i}"]}


def drop_mostly_null(df: DataFrame, threshold: float = 0.90) -> tuple[DataFrame, list[str]]:
    """Drops columns whose null share is above the threshold; returns their names too."""
    nulls, _ = null_and_constant_columns(df)
    gone = [c for c in df.columns if nulls[c] > threshold]
    return df.drop(*gone), gone


def drop_constant(df: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drops columns with at most one distinct value besides null, except those to keep."""
    _, same = null_and_constant_columns(df)
    gone = [c for c in df.columns if c in same and c not in set(keep)]
    return df.drop(*gone), gone


def clip_column(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, clip(_name(column), low, high))


def count_outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: how many values lie below and above the range."""
    return df.agg(
        F.count_if(_name(column) < low).alias("below"), F.count_if(_name(column) > high).alias("above")
    )


@dataclass(frozen=True)
class CleaningSpec:
    """What one data set needs beyond snake case names and stripped texts.

    Steps run in the order of the fields: drops and flags see the original names,
    ``sort`` the new ones."""

    require: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    compact_dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    comma_numbers: tuple[str, ...] = ()
    value_maps: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    drop_mostly_null: bool = False
    rename: dict[str, str] = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    drop_constant: bool = False
    keep_constant: tuple[str, ...] = ()
    flags: dict[str, Callable[[], Column]] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    sort: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cleaned:
    table: DataFrame
    dropped: list[str]


def clean(df: DataFrame, spec: CleaningSpec, *, null_threshold: float = 0.90) -> Cleaned:
    """Runs a cleaning spec. At most one small aggregate is executed, and only if the spec
    drops columns by their content; all else stays lazy."""
    has = set(df.columns)

    def present(names: Iterable[str]) -> list[str]:
        return [n for n in names if n in has]

    df = df.dropna(subset=present(spec.require)) if spec.require else df
    parsed: dict[str, Column] = {c: parse_date(_name(c)) for c in present(spec.dates)}
    parsed |= {c: parse_yyyymmdd(_name(c)) for c in present(spec.compact_dates)}
    parsed |= {c: to_number(_name(c)) for c in present(spec.numbers)}
    parsed |= {c: comma_number(_name(c)) for c in present(spec.comma_numbers)}
    parsed |= {n: lookup(_name(c), table) for n, (c, table) in spec.value_maps.items() if c in has}
    df = df.withColumns(parsed) if parsed else df
    df = df.dropna(subset=present(set(spec.require) & set(spec.dates))) if spec.require else df
    if spec.flags:
        df = df.withColumns({n: flag(make()) for n, make in spec.flags.items()})

    dropped = present(spec.drop)
    df = df.drop(*dropped)
    if spec.drop_mostly_null or spec.drop_constant:
        nulls, same = null_and_constant_columns(df)
        gone = [
            c
            for c in df.columns
            if (spec.drop_mostly_null and nulls[c] > null_threshold)
            or (spec.drop_constant and c in same and c not in spec.keep_constant)
        ]
        df, dropped = df.drop(*gone), dropped + gone
    df = df.withColumnsRenamed(spec.rename)
    for column, (low, high) in spec.clip.items():
        if column in df.columns:
            df = clip_column(df, column, low, high)
    df = snake_columns(strip_columns(df))
    return Cleaned(sort_rows(df, [s for s in spec.sort if s in df.columns]), dropped)


def sort_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in an order, nulls last. Rows equal in it are spread by a hash, so that a date
    with many rows is sorted by several tasks."""
    if not order:
        return df
    return df.orderBy(*[F.asc_nulls_last(c) for c in order], F.xxhash64(*[_name(c) for c in df.columns]))


def generic_spec(date_columns: Sequence[str], columns: Sequence[str]) -> CleaningSpec:
    """Spec of a data set without rules of its own: dates, mostly empty columns, and the
    order of the first date column it has."""
    first = [snake_name(c) for c in date_columns if c in columns][:1]
    return CleaningSpec(dates=tuple(date_columns), drop_mostly_null=True, sort=tuple(first))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

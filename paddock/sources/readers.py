"""Readers. Files are read with declared types; without a schema all columns are text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.dates import parse_date
from paddock.functions.text import comma_number, snake_columns, to_number
from paddock.sources.quoted import header_of, read_quoted, records
from paddock.sources.schemas import ENDPOINT_SCHEMA, FUTURES_SCHEMA, OTHER_TABLES, PRODUCER_DATES, PRODUCER_SCHEMAS

DELIMITERS = {".csv": ",", ".tsv": "\t"}


# Texts that stand for a missing value in raw files.
MISSING_MARKS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _separator(path: str) -> str:
    return next((s for ext, s in DELIMITERS.items() if path.lower().endswith(ext)), ",")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool = False) -> DataFrame:
    """Delimited file or folder with a header line; ``.tsv`` paths are split at tabs.

    Quoted fields may hold separators, doubled quotes and line breaks; a file is read by many tasks
    all the same (see ``quoted``), or with ``multi_line`` by one through Spark's own parser. With a schema the
    header must have its names; the columns are read as text and cast by :func:`declared`."""
    if multi_line:
        reader = _reader(spark, _separator(path))
        return reader.csv(path) if schema is None else declared(reader.schema(_texts(schema)).option("enforceSchema", False).csv(path), schema)
    rows = read_quoted(spark, path, _separator(path), schema and schema.fieldNames())
    return rows if schema is None else declared(rows, schema)


def _reader(spark: SparkSession, sep: str) -> DataFrameReader:
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True)


def _texts(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _declared(col: Column, kind: T.DataType) -> Column:
    number = comma_number(F.trim(col))
    if isinstance(kind, T.IntegralType):
        return F.when(number == F.rint(number), number).cast(kind)
    return number.cast(kind) if isinstance(kind, T.NumericType) else col.cast(kind)


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the declared types. Whole numbers may be written ``1200.0`` or ``1,300``."""
    return df.select(*[_declared(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])


def failed_casts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Per column: texts that are there and are null as the declared type."""
    texts = read_quoted(spark, path, _separator(path), schema.fieldNames())
    lost = {f.name: F.col(f"`{f.name}`").isNotNull() & _declared(F.col(f"`{f.name}`"), f.dataType).isNull() for f in schema.fields}
    counts = [F.struct(F.lit(n).alias("column"), F.count_if(c).alias("failed")) for n, c in lost.items()]
    return texts.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw delimited file with every column as text. A repeated header gets ``.1``, ``.2``
    and so on behind it, and the usual marks for a missing value become null."""
    sep = _separator(path)
    found = [r["record"] for r in records(spark, path, sep).where("first").orderBy("path").limit(1).collect()]
    header = [v or f"Unnamed: {i}" for i, v in enumerate(header_of(found[0], sep) if found else [])]
    names = [f"{h}.{n}" if (n := header[:i].count(h)) else h for i, h in enumerate(header)]
    table = read_quoted(spark, path, sep, names, check_header=False)
    return table.select(*[F.when(~F.col(f"`{n}`").isin(MISSING_MARKS), F.col(f"`{n}`")).alias(n) for n in names])


def read_producer(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the producer tables: declared types, snake case names, parsed dates."""
    table = snake_columns(read_delimited(spark, path, PRODUCER_SCHEMAS[name]))
    return table.withColumns({c: parse_date(F.col(c)) for c in PRODUCER_DATES[name]})


def read_other(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the market, weather, health or barn tables: snake case names, parsed dates, numbers where the
    table has them; other columns stay texts. Whatever columns the file has are kept."""
    dates, numbers = OTHER_TABLES[name]
    table = snake_columns(read_delimited(spark, path))
    parsed = {c: parse_date(F.col(c)) for c in dates if c in table.columns}
    return cast_numbers(table.withColumns(parsed) if parsed else table, numbers)


def read_endpoint(spark: SparkSession, path: str) -> DataFrame:
    """Daily futures closes of all contracts, without the rows that have no trading day."""
    table = snake_columns(read_delimited(spark, path, ENDPOINT_SCHEMA))
    return table.withColumn("trading_day", parse_date(F.col("trading_day"))).dropna(subset=["trading_day"])


def read_futures(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Daily prices of many contracts, one file each, with the file a row came from."""
    table = read_quoted(spark, paths, ",", FUTURES_SCHEMA.fieldNames(), name_column="source_file")
    typed = [_declared(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in FUTURES_SCHEMA.fields]
    table = table.select(*typed, "source_file")
    return table.withColumn("time", parse_date(F.col("time")))


def cast_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns as numbers, null where they are none."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in present}) if present else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob of paths, holds anything, on whatever file system it names: whether Spark's
    file source finds files there."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_optional(
    spark: SparkSession, candidates: Sequence[str], read: Callable[[SparkSession, str], DataFrame] = read_delimited
) -> DataFrame | None:
    """The first of the candidate paths that exists, or None."""
    for path in candidates:
        if path_exists(spark, path):
            return read(spark, path)
    return None


def list_tables(spark: SparkSession, folder: str, suffixes: Sequence[str] = tuple(DELIMITERS)) -> dict[str, str]:
    """Base name and path of each data file in a folder, in order of the names. Spark lists the files
    and returns one row each; their content is not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder.rstrip("/"))
    found = {unquote(r["path"].rsplit("/", 1)[1]): r["path"] for r in listed.select("path").collect()}
    return {n.removesuffix(s): p for n, p in sorted(found.items()) for s in suffixes if n.endswith(s)}


def read_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A derived table by name, from a folder of Parquet tables or from the catalog."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}") if folder else spark.table(name)

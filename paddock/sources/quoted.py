"""Splittable reading of delimited files whose quoted fields may hold line breaks.

Spark reads the files as lines, cut into byte ranges as its file source does it. A first pass finds for
each range in which state (inside quotes or not) it ends, for either state in which it may start.
Composed along the file that gives the state at the start of every range, so in a second pass
each range gives its whole records, the lines before its first record start and the open record at its
end. Only those pieces, two a range at most, are put together across ranges.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = "path string, block bigint, from_plain boolean, from_quoted boolean"
PIECES = "path string, name string, block bigint, kind string, first boolean, text string"
WHOLE, HEAD, TAIL = "whole", "head", "tail"


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that starts at a field (or, with ``inside``, within quotes) ends within quotes."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside and not line.startswith('"', at):
            at = line.find(sep, at) + 1
            if not at:
                return False
            continue
        at += not inside
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('""', at):
                break
            at += 2
        inside, at = False, line.find(sep, at + 1) + 1
        if not at:
            return False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int], str]]:
    for batch in batches:
        value, path, name, block = (batch.column(i).to_pylist() for i in range(4))
        yield from zip(zip(path, name, block), value)


def _states(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (path, _, block), lines in groupby(_lines(batches), key=lambda x: x[0]):
            plain, quoted = False, True
            for _, line in lines:
                plain, quoted = ends_inside(line, plain, sep), ends_inside(line, quoted, sep)
            out.append((path, block, plain, quoted))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "block", "from_plain", "from_quoted"), r)) for r in out], schema=_schema(RANGES))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _pieces(sep: str, starts: dict[tuple[str, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_schema(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path, name, block), lines in groupby(_lines(batches), key=lambda x: x[0]):
            if (path, block) not in starts:
                raise RuntimeError(f"the byte ranges of {path} changed between two passes")
            inside, held, head, first = starts[path, block], [], starts[path, block], block == 0
            for _, line in lines:
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if not inside:
                    out.append((path, name, block, HEAD if head else WHOLE, first, "\n".join(held)))
                    held, head, first = [], False, False
                    if len(out) >= 5000:
                        yield batch(out)
                        out = []
            if held:
                out.append((path, name, block, HEAD if head else TAIL, first, "\n".join(held)))
        yield batch(out)

    return run


def records(spark: SparkSession, paths: str | Sequence[str], sep: str) -> DataFrame:
    """(path, name, first, record) for every record of the files; ``first`` marks a file's first one.

    The driver holds one state for each byte range (128 MB by default), not for rows."""
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    starts: dict[tuple[str, int], bool] = {}
    inside, last = False, None
    for path, block, plain, quoted in sorted(tuple(r) for r in lines.mapInArrow(_states(sep), RANGES).collect()):
        inside, last = inside and path == last, path
        starts[path, block] = inside
        inside = quoted if inside else plain
    pieces = lines.mapInArrow(_pieces(sep, starts), PIECES)
    line = Window.partitionBy("path", "name").orderBy("block", F.col("kind") == TAIL)
    open_ = pieces.where(F.col("kind") != WHOLE).withColumns({"part": F.row_number().over(line), "begins": F.count_if(F.col("kind") == TAIL).over(line)})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n")
    joined = open_.groupBy("path", "name", "begins").agg(F.bool_or("first").alias("first"), text.alias("record"))
    columns = ["path", "name", "first", F.regexp_replace("record", "\\r$", "").alias("record")]
    found = pieces.where(F.col("kind") == WHOLE).withColumnRenamed("text", "record").select(*columns).unionByName(joined.select(*columns))
    return found.where("record <> ''").withColumn("record", F.when(F.col("first"), F.regexp_replace("record", "^\\uFEFF", "")).otherwise(F.col("record")))


def header_of(record: str, sep: str) -> list[str]:
    return next(csv.reader([record], delimiter=sep), [])


def _safe(header: list[str]) -> list[str]:
    """Empty names become _c0 and so on, repeated ones get their place behind them."""
    lower = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if lower.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def read_quoted(
    spark: SparkSession, paths: str | Sequence[str], sep: str, names: Sequence[str] | None = None, *, check_header: bool = True, name_column: str | None = None
) -> DataFrame:
    """The files' records as text columns, without their headers.

    With ``names`` the header of every file must have them, in any case; without, they are those of the first
    file. ``check_header=False`` only counts on their places. ``name_column`` adds the name of the file a row came from."""
    found = records(spark, paths, sep)
    headers = [header_of(r["record"], sep) for r in found.where("first").groupBy("record").agg(F.min("path").alias("path")).orderBy("path").collect()]
    known = list(names) if names is not None else _safe(headers[0]) if headers else []
    for header in headers if names is not None and check_header else []:
        if [h.lower() for h in header] != [n.lower() for n in known]:
            raise ValueError(f"the header {header} is not {known}")
    if not known:
        return spark.range(0).select()
    ddl = ", ".join(f"c{i} STRING" for i in range(len(known)))
    row = F.from_csv("record", ddl, {"sep": sep, "quote": '"', "escape": '"'})
    rows = found.where("NOT first").select(row.alias("__row"), "name")
    extra = [F.col("name").alias(name_column)] if name_column else []
    return rows.select(*[F.col(f"__row.c{i}").alias(n) for i, n in enumerate(known)], *extra)

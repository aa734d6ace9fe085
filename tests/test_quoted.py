import random

import pytest
from pyspark.sql import functions as F

from paddock.sources import quoted, readers


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few KB, as large files have them of 128 MB."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rng):
    kind = rng.random()
    if kind < 0.4:
        return str(rng.randrange(10**6))
    if kind < 0.5:
        return ""
    if kind < 0.55:
        return 'inch 5" pipe'  # a quote inside a plain field opens nothing
    text = "".join(rng.choice(["a", "é", ",", '""', "\n", " ", "漢", "\r\n", "x" * 30]) for _ in range(rng.randrange(12)))
    return f'"{text}"'


def written(folder, rng, records, line_end="\n"):
    path = folder / "t.csv"
    lines = ["a,b,c"] + [f"{i},{field(rng)},{field(rng)}" for i in range(records)]
    path.write_bytes((line_end.join(lines) + line_end).encode())
    return str(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_what_one_task_reads(spark, tmp_path, small_ranges, rows, seed):
    path = written(tmp_path, random.Random(seed), 4000)
    got = readers.read_delimited(spark, path)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 8
    assert rows(got) == rows(readers.read_delimited(spark, path, multi_line=True))


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges, rows):
    long = "line with, commas\n" * 3000
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,x\n\n3,"{long}"\n')
    assert rows(readers.read_delimited(spark, f"{tmp_path}/t.csv")) == [("1", long), ("2", "x"), ("3", long)]


def test_line_ends_and_a_mark_at_the_start(spark, tmp_path, small_ranges, rows):
    (tmp_path / "t.csv").write_bytes("﻿a,b\r\n1,\"x\r\ny\"\r\n\r\n2,z".encode())
    got = readers.read_delimited(spark, f"{tmp_path}/t.csv")
    assert got.columns == ["a", "b"] and rows(got) == [("1", "x\r\ny"), ("2", "z")]


def test_every_file_has_its_header(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("A,B\n3,4\n")
    got = quoted.read_quoted(spark, f"{tmp_path}/*.csv", ",", ["a", "b"], name_column="file")
    assert rows(got) == [("1", "2", "x.csv"), ("3", "4", "y.csv")]
    (tmp_path / "z.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        quoted.read_quoted(spark, f"{tmp_path}/*.csv", ",", ["a", "b"])


def test_empty_files_and_repeated_names(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "names.csv").write_text("a,,A\n1,2,3\n")
    assert readers.read_delimited(spark, f"{tmp_path}/none.csv").count() == 0
    assert readers.read_delimited(spark, f"{tmp_path}/names.csv").columns == readers.read_delimited(spark, f"{tmp_path}/names.csv", multi_line=True).columns


@pytest.mark.parametrize("line,inside,want", [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('""', True, True), ('"a""",b', False, False), ('5" x,"', False, True), ("", True, True), ('",",', True, True)])
def test_states(line, inside, want):
    assert quoted.ends_inside(line, inside, ",") is want

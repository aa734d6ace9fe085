from datetime import date

import pytest
from pyspark.sql import functions as F

from paddock.plans import cleanup
from paddock.session import ensure_checkpoint_dir
from paddock.sources import readers, writers
from paddock.sources.schemas import PRODUCER_SCHEMAS, UPLOAD_SCHEMAS, struct


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_delimiter_follows_the_suffix(spark, tmp_path):
    schema = struct("a STRING, b INT")
    comma = put(tmp_path, "x.csv", "a,b\r\nu,1\r\n")
    tabs = put(tmp_path, "x.tsv", "a\tb\nu\t1\n")
    for path in (comma, tabs):
        assert [tuple(r) for r in readers.read_delimited(spark, path, schema).collect()] == [("u", 1)]


def test_raw_files_get_distinct_headers_and_nulls(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'LBS,$,LBS,$,note\n1,2,3,4,NA\n5,,7,8," keep "\n')
    table = readers.read_raw(spark, path)
    assert table.columns == ["LBS", "$", "LBS.1", "$.1", "note"]
    assert [tuple(r) for r in table.collect()] == [("1", "2", "3", "4", None), ("5", None, "7", "8", " keep ")]


def test_producer_tables_are_typed_and_dated(spark, tmp_path):
    head = ",".join(PRODUCER_SCHEMAS["farrowing"].fieldNames())
    path = put(tmp_path, "farrowing.csv", f"{head}\r\n1/6/2025,Alpha,553,478,6473,5881,514,5367,13.58,19,n\r\n")
    row = readers.read_producer(spark, "farrowing", path).first()
    assert (row["week_start"], row["weaned_pigs"], row["avg_wean_weight_lb"]) == (date(2025, 1, 6), 5367, 13.58)


def test_endpoint_rows_need_a_day(spark, tmp_path):
    head = "Commodity,month,year,tradingDay,close,commodityMonth,monthName,weekofYear,week,monthDay,symbol"
    path = put(tmp_path, "endpoint.csv", f"{head}\nHE,M,25,2025-03-01,90.5,,,,,,HEM25\nHE,M,25,,91.5,,,,,,HEM25\n")
    assert [(r["trading_day"], r["close"]) for r in readers.read_endpoint(spark, path).collect()] == [(date(2025, 3, 1), 90.5)]


def test_futures_of_many_files_keep_their_origin(spark, tmp_path, rows):
    head = "symbol,time,open,high,low,close,volume,open_interest"
    put(tmp_path, "hem25.csv", f"{head}\nHEM25,2025-03-03,1,2,0.5,1.5,,\n")
    put(tmp_path, "heq25.csv", f"{head}\nHEQ25,2025-03-04,1,2,0.5,1.5,7,8\n")
    table = readers.read_futures(spark, f"{tmp_path}/*.csv")
    assert rows(table, "symbol", "time", "volume", "source_file") == [
        ("HEM25", date(2025, 3, 3), None, "hem25.csv"),
        ("HEQ25", date(2025, 3, 4), 7.0, "heq25.csv"),
    ]


def test_optional_sources(spark, tmp_path):
    path = put(tmp_path, "there.csv", "a\n1\n")
    assert readers.read_optional(spark, [f"{tmp_path}/missing.csv", path]).count() == 1
    assert readers.read_optional(spark, [f"{tmp_path}/missing.csv"]) is None


def test_cast_numbers_skips_absent_columns(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert tuple(readers.cast_numbers(df, ["a", "b", "c"]).first()) == (1.0, None)


def test_writers_count_while_writing(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") % 2).alias("k"))
    assert writers.write_csv(df, str(tmp_path), "Pork Cuts (2)") == {"file": "pork_cuts_2.csv", "rows": 5, "cols": 2, "columns": ["id", "k"]}
    assert readers.read_delimited(spark, f"{tmp_path}/pork_cuts_2.csv").count() == 5
    entry = writers.write_parquet(df, str(tmp_path), "Daily", ["k"])
    assert entry["rows"] == 5 and readers.read_table(spark, "daily", str(tmp_path)).where("k = 1").count() == 2
    assert writers.write_sorted_parquet(df, str(tmp_path), "sorted", ["id"], 2)["rows"] == 5
    writers.write_parquet(df.limit(1), str(tmp_path), "Daily")
    assert readers.read_table(spark, "daily", str(tmp_path)).count() == 1


def test_manifest_round_trip(spark, tmp_path):
    manifest = {"market": [{"file": "a.csv", "rows": 3}], "notes": {"a": "kept"}}
    writers.write_manifest(spark, manifest, f"{tmp_path}/manifest")
    assert readers and writers.read_manifest(spark, f"{tmp_path}/manifest") == manifest


def test_catalog_tables_are_replaced(spark):
    writers.save_table(spark.range(3), "paddock_test_table")
    writers.save_table(spark.range(2), "paddock_test_table")
    try:
        assert readers.read_table(spark, "paddock_test_table").count() == 2
    finally:
        spark.sql("DROP TABLE paddock_test_table")


def test_cleaning_a_folder(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    put(raw, "Pork Production.csv", "Date,LBS,Void\n2010-01-09 00:00:00.000,426.8,\n2010-01-02 00:00:00.000,387.3,\n")
    put(raw, "Western Colt.csv", 'report_date,Estimated_Today\n1/2/2025,"1,234"\n')
    entries = cleanup.clean_folder(spark, str(raw), str(out))
    assert [(e["file"], e["rows"], e["columns"]) for e in entries] == [
        ("pork_production.csv", 2, ["date", "lbs"]),
        ("western_colt.csv", 1, ["report_date", "estimated_today"]),
    ]
    assert [r["date"] for r in readers.read_delimited(spark, f"{out}/pork_production.csv").collect()] == ["2010-01-02", "2010-01-09"]
    assert readers.read_delimited(spark, f"{out}/western_colt.csv").first()["estimated_today"] == "1234.0"


def test_a_whole_run_writes_a_manifest(spark, tmp_path):
    raw, futures, out = tmp_path / "raw", tmp_path / "futures", str(tmp_path / "out")
    raw.mkdir()
    futures.mkdir()
    put(raw, "Sales.csv", "Date,Weekly Exports\n1/9/2025,5\n1/2/2025,6\n")
    put(futures, "HEM25 HISTORY.csv", "Symbol,Time,Open,High,Low,Close,Volume,Open Interest\nHEM25,2025-01-02,1,2,0.5,x,,\n")
    nursery = ",".join(PRODUCER_SCHEMAS["nursery"].fieldNames())
    flow = ",".join(PRODUCER_SCHEMAS["flow"].fieldNames())
    paths = {
        "nursery": put(tmp_path, "n.csv", f"{nursery}\nPG-1,1/1/2025,N,1,S,W,100,100,12,21,Negative,1,x\nPG-2,1/2/2025,N,2,S,W,100,90,12,21,Negative,1,x\n"),
        "flow": put(tmp_path, "f.csv", f"{flow}\nPG-1,3/1/2025,N,1,Finisher E,F1,Transfer,96,50,m\nPG-2,3/1/2025,N,2,Finisher E,F2,Transfer,91,50,m\nPG-3,3/1/2025,N,2,Finisher E,F2,Transfer,91,50,k\n"),
    }
    manifest = cleanup.run(spark, out, market=str(raw), futures=[str(futures)], producer=paths)
    assert [(e["file"], e["rows"]) for g in ("market", "futures", "producer") for e in manifest[g]] == [
        ("sales.csv", 2), ("hem25_history.csv", 1), ("nursery.csv", 2), ("flow.csv", 3),
    ]
    assert manifest["producer"][0]["columns"] == ["pig_group_id", "placement_date", "nursery_barn", "received_head"]
    assert manifest["validation"]["keys"] == {"flow": {"orphans": 1, "overlap": 2}}
    assert manifest["validation"]["head_reconciliation"] == {"loss": 1, "issue": 1}
    assert manifest["month_codes"]["M"] == "Jun"
    assert writers.read_manifest(spark, f"{out}/manifest") == manifest
    assert readers.read_table(spark, "head_reconciliation", out).count() == 2


def test_schemas():
    assert {n: len(r) for n, r in UPLOAD_SCHEMAS.items()} == {
        "Nursery Intake": 8, "Packer Settlement": 11, "Accounting / Costs": 10, "Hedging Positions": 8, "Barn Environmental": 7,
    }
    assert [r.name for r in UPLOAD_SCHEMAS["Barn Environmental"] if r.required] == ["Date", "Site", "Barn"]


def test_checkpoint_folder_of_the_session_is_kept(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def test_local_folder_is_refused_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {"x": 1}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('a,b,c\n1,"a ""b"" c, d",x\n2,"two\nlines",y\n')
    want = [("1", 'a "b" c, d', "x"), ("2", "two\nlines", "y")]
    for read in (readers.read_delimited, readers.read_raw):
        assert sorted(tuple(r) for r in read(spark, f"{tmp_path}/raw.csv").collect()) == want
    writers.write_csv(readers.read_raw(spark, f"{tmp_path}/raw.csv"), str(tmp_path / "out"), "again")
    assert sorted(tuple(r) for r in readers.read_raw(spark, f"{tmp_path}/out/again.csv").collect()) == want


def test_whole_numbers_in_other_forms(spark, tmp_path):
    kind = struct("g STRING, n INT, v DOUBLE")
    (tmp_path / "t.csv").write_text('g,n,v\na,1200.0,"1,300.5"\nb,"1,300",2\nc,1.5,x\nd,,\n')
    got = [tuple(r) for r in readers.read_delimited(spark, f"{tmp_path}/t.csv", kind).collect()]
    assert got == [("a", 1200, 1300.5), ("b", 1300, 2.0), ("c", None, None), ("d", None, None)]
    failed = {r["column"]: r["failed"] for r in readers.failed_casts(spark, f"{tmp_path}/t.csv", kind).collect()}
    assert failed == {"g": 0, "n": 1, "v": 1}


def test_folders_hold_both_kinds_of_files(spark, tmp_path):
    for name in ("a.csv", "b.tsv", "c.txt"):
        (tmp_path / name).write_text("x\n1\n")
    assert list(readers.list_tables(spark, str(tmp_path))) == ["a", "b"]

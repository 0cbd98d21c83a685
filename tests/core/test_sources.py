import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources import captures, sinks, tables
from ledgerloom.sources.paged import PagedSource
from ledgerloom.streaming import incremental


def test_csv_with_bom_and_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x, y"\nz,q\n')
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string, extra date")
    assert [tuple(r) for r in df.collect()] == [(1, "x, y", None), (None, "q", None)]
    with pytest.raises(tables.SchemaMismatch):
        tables.require(df, ["id", "missing"])
    assert tables.absent(df, StructType.fromDDL("id int, other int")) == ["other"]


def test_snapshots(spark, tmp_path):
    for n in ("x_2020-01-01.csv", "x_2021-01-01.csv", "x_2021-01-01_SUPERSEDED.csv"):
        (tmp_path / n).write_text("a\n1\n")
    assert tables.latest_snapshot(spark, str(tmp_path), r"x_\d{4}-\d\d-\d\d\.csv").endswith("x_2021-01-01.csv")
    assert tables.latest_snapshot(spark, str(tmp_path), "nothing", required=False) is None
    with pytest.raises(FileNotFoundError):
        tables.latest_snapshot(spark, str(tmp_path), "nothing")


def test_bulk_json_and_flatten(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"id": "1", "device": {"openfda": {"device_class": "2"}}}, {"id": "2"}]}))
    df = tables.read_bulk_json(spark, str(tmp_path / "b.json"), "id string, device struct<openfda:struct<device_class:string>>")
    flat = tables.flatten(df)
    assert flat.columns == ["id", "device.openfda.device_class"]
    assert sorted(tuple(r) for r in flat.collect()) == [("1", "2"), ("2", None)]


def test_partial_cache_is_refused(spark, tmp_path):
    at = str(tmp_path / "c")
    spark.range(4).repartition(2).write.parquet(at)
    assert tables.read_cached_parquet(spark, at, 2, "id long", ["id"]).count() == 4
    with pytest.raises(tables.PartialCache):
        tables.read_cached_parquet(spark, at, 3, "id long")


def test_indexes(spark, tmp_path):
    (tmp_path / "i.txt").write_text("http://a 20200101\nhttp://b 20210101\n")
    assert tables.read_url_index(spark, str(tmp_path / "i.txt")).count() == 2
    lines = ['com,a)/ 2020 {"url": "http://a/warning", "status": "200", "mime": "text/html"}', '{"url": "http://a/warning", broken', '{"url": "http://b/warning", "status": "404", "mime": "text/html"}', '{"url": "http://c"}']
    (tmp_path / "j.txt").write_text("\n".join(lines))
    got = tables.read_json_lines(spark, str(tmp_path / "j.txt"), "url string, status string, mime string", "warning", mime="text/html")
    assert [tuple(r) for r in got.collect()] == [("http://a/warning", "200", "text/html")]


def test_filings(spark, tmp_path):
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-K", "8-K", "10-K"], "filingDate": ["2020-01-01", "2020-01-02", "2001-01-01"], "reportDate": ["2019-12-31", "", "2000-12-31"], "primaryDocument": ["a", "b", "c"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "7", "name": "X", "sic": "3841", "filings": {"recent": recent}}))
    got = tables.read_filings(spark, str(tmp_path / "s.json"), ["10-K"], 2010).collect()
    assert [(r.accession, str(r.report_date)) for r in got] == [("1", "2019-12-31")]


def test_union_of_keyed_tables(spark, tmp_path):
    (tmp_path / "k1.csv").write_text("gvkey,cik\n1,9\n")
    (tmp_path / "k2.csv").write_text("gvkey,name\n2,x\n")
    (tmp_path / "k3.csv").write_text("other\n1\n")
    got = tables.union_keyed_tables(spark, [str(tmp_path / f"k{i}.csv") for i in (1, 2, 3)], "gvkey", ["cik", "name"])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [("1", "9", None), ("2", None, "x")]


def test_paged_source(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"result": [{"id": i, "name": f"n{i}"} for i in range(23, 0, -1)]}))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").options(url=f"file://{tmp_path}/p.json", rows="5", sort="id", columns="id int, name string").load()
    assert df.rdd.getNumPartitions() == 5 and sorted(r.id for r in df.collect()) == list(range(1, 24))


def test_archive_record():
    page = b"<html>hi</html>"
    chunked = b"5\r\n<html\r\na\r\n>hi</html>\r\n0\r\n\r\n"
    head = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n"
    assert captures.record_body(gzip.compress(head + b"Content-Type: text/html\r\n\r\n" + page)) == page
    assert captures.record_body(gzip.compress(head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked)) == page
    assert captures.record_body(gzip.compress(head + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(page))) == page
    assert captures.record_body(b"junk") is None and captures.record_body(None) is None


def test_listing_rows(spark):
    page = "<table><tr><th>Firm</th></tr><tr><td><a href='/x'>Acme &amp; Co</a></td><td> 1/2/20 </td></tr></table>"
    assert captures.table_rows(page) == [(["Firm"], None), (["Acme & Co", "1/2/20"], "/x")]
    spark.udtf.register("listing_rows", captures.ListingRows)
    spark.createDataFrame([(page,)], "html string").createOrReplaceTempView("listing_pages")
    got = spark.sql("SELECT row_no, cells, link FROM listing_pages, LATERAL listing_rows(html)").collect()
    assert [(r.row_no, r.link) for r in got] == [(0, None), (1, "/x")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 1.25), (2, None, None)], "n int, t string, v double")
    assert sinks.to_markdown(df).splitlines()[2] == "| 1 | a\\|b | 1.2 |"
    assert r"\begin{tabular}{lll}" in sinks.to_latex(df) and sinks.tex_escape("a_b&c") == r"a\_b\&c"
    with pytest.raises(ValueError):
        sinks.to_markdown(spark.range(5), most=3)
    assert sinks.percent(1, 4) == "25.0%" and sinks.percent(1, 0) == "n/a"
    sinks.write_csv(df, str(tmp_path / "out"), compression="gzip")
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 2
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"rows": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"rows": 2}
    sinks.write_sheets({"one": df, "two": df}, str(tmp_path / "book"))
    assert tables.read_csv(spark, str(tmp_path / "book/two")).count() == 2


def test_partitions_replace_themselves(spark, tmp_path):
    at = str(tmp_path / "parts")
    sinks.write_partitions(spark.createDataFrame([(1, "q1"), (2, "q2")], "n int, q string"), at, ["q"])
    sinks.write_partitions(spark.createDataFrame([(3, "q2")], "n int, q string"), at, ["q"])
    assert sorted(tuple(r) for r in spark.read.parquet(at).select("n", "q").collect()) == [(1, "q1"), (3, "q2")]


def test_document_files_follow_the_manifest(spark, tmp_path):
    at = str(tmp_path / "docs")
    sinks.write_documents(spark.createDataFrame([("a", "x"), ("b", "y")], "name string, text string"), at, "name", "text")
    removed = sinks.write_documents(spark.createDataFrame([("b", "z")], "name string, text string"), at, "name", "text")
    assert removed == 1 and [tuple(r) for r in spark.read.text(at).select("document", "value").collect()] == [("b", "z")]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    keep = lambda df: df.filter("event_type = 'purchase'")
    for _ in range(2):  # a second run finds nothing new
        arrivals = incremental.read_arrivals(spark, str(tmp_path / "in"), "event_id long, user_id long, event_type string, value double", files_per_trigger=2)
        incremental.filter_arrivals(arrivals, keep, str(tmp_path / "out"), ["event_type"], str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in keep(events).collect())


def test_stream_assignment_and_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    periods = events.groupBy("user_id").agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end")).withColumn("p", F.lit("p1"))
    arrivals = incremental.read_arrivals(spark, str(tmp_path / "ev"), "event_id long, user_id long, ts timestamp")
    placed = incremental.assign_stream(arrivals, periods, "user_id", "ts", ["p"])
    placed.writeStream.format("memory").queryName("placed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    inside = events.join(periods, "user_id").filter("ts > period_start AND ts <= period_end").count()
    assert spark.table("placed").filter("p IS NOT NULL").count() == inside and spark.table("placed").count() == events.count()
    counted = incremental.windowed_panel(arrivals, "ts", ["user_id"], "1 day", "2 days", {"n_odd": F.col("event_id") % 2 == 1})
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counted").agg(F.sum("n_events")).first()[0] == events.count()

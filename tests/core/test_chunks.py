"""Manifests of caches, the commit log of partitions, and shards of filings."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import chunks, tables


@pytest.fixture
def cache(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    for n in range(3):
        pq.write_table(pa.table({"id": pa.array([n, n + 10], pa.int64()), "v": ["a", None]}), folder / f"p{n}.parquet")
    pq.write_table(pa.table({}), folder / "empty.parquet")  # a partition without rows has no columns either
    path = str(tmp_path / "manifest.json")
    chunks.write_chunk_manifest(spark, str(folder), path, "id long, v string", export_date="2020-01-01")
    return folder, path


def test_manifest(spark, cache):
    folder, path = cache
    manifest = chunks.read_manifest(spark, path)
    assert manifest["export_date"] == "2020-01-01" and {n: c["rows"] for n, c in manifest["chunks"].items()} == {"p0.parquet": 2, "p1.parquet": 2, "p2.parquet": 2, "empty.parquet": 0}
    df = chunks.read_gated(spark, str(folder), manifest, ["id"])
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 10, 11, 12]
    assert not any("empty" in f for f in df.inputFiles())


def test_a_folder_unlike_its_manifest_is_refused(spark, cache):
    folder, path = cache
    manifest = chunks.read_manifest(spark, path)
    whole = (folder / "p1.parquet").read_bytes()
    refused = lambda: pytest.raises(tables.PartialCache)
    os.rename(folder / "p0.parquet", folder / "p9.parquet")
    with refused() as e:
        chunks.read_gated(spark, str(folder), manifest)
    assert "missing: p0.parquet" in str(e.value) and "not in the manifest: p9.parquet" in str(e.value)
    os.rename(folder / "p9.parquet", folder / "p0.parquet")
    (folder / "p1.parquet").write_bytes(whole[:-9])
    with refused() as e:
        chunks.gate(spark, str(folder), manifest)
    assert "of another size: p1.parquet" in str(e.value)


def test_no_chunk_has_rows(spark, tmp_path):
    (tmp_path / "c").mkdir()
    pq.write_table(pa.table({}), tmp_path / "c" / "empty.parquet")
    manifest = chunks.write_chunk_manifest(spark, str(tmp_path / "c"), str(tmp_path / "m.json"), "id long")
    assert chunks.read_gated(spark, str(tmp_path / "c"), manifest).count() == 0


def _load(spark, path):
    rows = spark.read.schema("id long, keep boolean").option("mode", "FAILFAST").json(path)
    return rows.filter("keep").select("id", F.lit(None).cast("string").alias("v"))


SCHEMA = "id long, v string"


def _parts(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    return {name: str(tmp_path / f"{name}.json") for name in texts}


def test_a_corrupt_partition_stays_its_own(spark, tmp_path):
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    row = lambda i, keep=True: json.dumps({"id": i, "keep": keep}) + "\n"
    parts = _parts(tmp_path, a=row(1) + row(2, False), b='{"id": "broken', c=row(3) + row(3), d=row(4, False))
    assert chunks.work_off(spark, parts, _load, target, log) == {"a": "committed", "b": "failed", "c": "committed", "d": "committed"}
    got = chunks.read_committed(spark, target, log, SCHEMA)
    assert sorted((r.id, r.partition) for r in got.collect()) == [(1, "a"), (3, "c"), (3, "c")]
    assert "error" in [x for x in chunks.attempts(spark, log) if x["partition"] == "b"][0]
    with pytest.raises(tables.PartialCache, match="not committed: b"):
        chunks.read_committed(spark, target, log, SCHEMA, only=["a", "b"])
    # The second run does what is missing, and nothing else.
    (tmp_path / "b.json").write_text(row(5))
    loaded = []
    again = lambda s, p: (loaded.append(p), _load(s, p))[1]
    assert chunks.work_off(spark, parts, again, target, log) == {"a": "kept", "b": "committed", "c": "kept", "d": "kept"}
    assert loaded == [parts["b"]] and chunks.committed(spark, log)["b"]["attempt"] == 2
    chunks.verify_committed(spark, target, log, SCHEMA)


def test_a_killed_attempt_is_not_seen(spark, tmp_path):
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    parts = _parts(tmp_path, a='{"id": 1, "keep": true}\n')
    # What a run leaves that dies after its rows are written and before they count.
    spark.createDataFrame([(99, "x")], SCHEMA).write.parquet(f"{target}/a/attempt=1")
    assert chunks.read_committed(spark, target, log, SCHEMA).count() == 0
    assert chunks.work_off(spark, parts, _load, target, log) == {"a": "committed"}
    assert [tuple(r) for r in chunks.read_committed(spark, target, log, SCHEMA).collect()] == [(1, None, "a")]
    assert chunks.committed(spark, log)["a"]["attempt"] == 2
    # Rows that change after they were committed are found.
    spark.createDataFrame([(7, None)], SCHEMA).write.mode("append").parquet(f"{target}/a/attempt=2")
    with pytest.raises(tables.PartialCache, match="other rows than were committed: a"):
        chunks.verify_committed(spark, target, log, SCHEMA)


def test_shards_of_filings(spark, tmp_path):
    block = lambda *rows: dict(zip(("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"), map(list, zip(*rows))))
    recent = block(("1", "10-K", "2020-01-01", "2019-12-31", "a"), ("2", "8-K", "2020-01-02", "", "b"))
    older = block(("1", "10-K", "2020-01-01", "2019-12-31", "a"), ("0", "10-Q", "2004-05-01", "2004-03-31", "c"), ("-1", "10-K", "1999-01-01", "", "d"))
    (tmp_path / "i").mkdir()
    (tmp_path / "s").mkdir()
    main = {"cik": "7", "name": "X", "sic": "3841", "filings": {"recent": recent, "files": [{"name": "CIK7-submissions-001.json"}]}}
    (tmp_path / "i" / "7.json").write_text(json.dumps(main))
    (tmp_path / "i" / "8.json").write_text(json.dumps({"cik": "8", "name": "Y", "sic": "1", "filings": {"recent": block(("8", "10-K", "2020-01-01", "", "z")), "files": []}}))
    (tmp_path / "s" / "CIK7-submissions-001.json").write_text(json.dumps(older))
    (tmp_path / "s" / "CIK9-submissions-001.json").write_text(json.dumps(block(("9", "10-K", "2020-01-01", "", "z"))))
    read = lambda: tables.read_filings(spark, str(tmp_path / "i"), ["10-K", "10-Q"], 2003, str(tmp_path / "s"))
    assert sorted((r.cik, r.accession, r.form) for r in read().collect()) == [("7", "0", "10-Q"), ("7", "1", "10-K"), ("8", "8", "10-K")]
    main["filings"]["files"].append({"name": "CIK7-submissions-002.json"})
    (tmp_path / "i" / "7.json").write_text(json.dumps(main))
    with pytest.raises(Exception, match="no such shard of filings: CIK7-submissions-002.json"):
        read().collect()

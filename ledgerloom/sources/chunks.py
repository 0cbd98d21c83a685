"""Caches of Parquet chunks behind a manifest, and partitions worked off one by one under a commit log.

Lists on the driver have one entry a chunk or partition, never one a row.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ledgerloom.operators.checks import Reconciliation

from .sinks import file_system, write_manifest, write_text
from .tables import PartialCache, list_files


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON file of facts, as ``write_manifest`` writes it."""
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


# ---------------------------------------------------------------- manifests


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    at, fs = file_system(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")} if fs.exists(at) else {}


#: A chunk without columns is smaller than this many bytes. Spark opens none of that kind, so small chunks are looked at apart.
SMALL = 4096


@F.pandas_udf(LongType())
def _footer_rows(content: pd.Series) -> pd.Series:
    return content.map(lambda c: pq.read_metadata(io.BytesIO(c)).num_rows)


def _rows(spark: SparkSession, folder: str, sizes: dict[str, int], schema: StructType) -> dict[str, int]:
    """Rows by chunk. No column is read, so they come from the files' footers, each read by a task."""
    path = lambda n: f"{folder.rstrip('/')}/{n}"
    name = F.col("_metadata.file_name").alias("chunk")
    out: dict[str, int] = {}
    if small := [path(n) for n, size in sizes.items() if size < SMALL]:
        found = spark.read.format("binaryFile").load(small).select(name, _footer_rows("content").alias("n"))
        out |= {r["chunk"]: r["n"] for r in found.collect()}
    if large := [path(n) for n, size in sizes.items() if size >= SMALL]:
        counted = spark.read.schema(schema).parquet(*large).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        out |= {r["chunk"]: r["n"] for r in counted.collect()}
    return out


def write_chunk_manifest(spark: SparkSession, folder: str, path: str, schema: str, **facts) -> dict:
    """Names, sizes and row counts of a folder's chunks, and the columns that those with rows have."""
    kind = StructType.fromDDL(schema)
    sizes = _sizes(spark, folder)
    rows = _rows(spark, folder, sizes, kind)
    chunks = {name: {"bytes": size, "rows": rows.get(name, 0)} for name, size in sizes.items()}
    manifest = {**facts, "schema": schema, "chunks": chunks}
    write_manifest(spark, path, manifest)
    return manifest


def gate(spark: SparkSession, folder: str, manifest: dict) -> list[str]:
    """Paths of the chunks that have rows, if the folder is what the manifest says; nothing is scanned.

    A chunk that is missing, not listed or of another size is named in the error.
    """
    listed, found = manifest["chunks"], _sizes(spark, folder)
    faults = {
        "missing": sorted(listed.keys() - found.keys()),
        "not in the manifest": sorted(found.keys() - listed.keys()),
        "of another size": sorted(n for n in listed.keys() & found.keys() if listed[n]["bytes"] != found[n]),
    }
    if any(faults.values()):
        raise PartialCache(f"{folder}: " + "; ".join(f"{what}: {', '.join(names)}" for what, names in faults.items() if names))
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(listed) if listed[n]["rows"]]


def read_gated(spark: SparkSession, folder: str, manifest: dict, columns: list[str] | None = None) -> DataFrame:
    """A complete cache; chunks without rows, which may lack columns too, are not opened. Without any, an empty table."""
    kind = manifest["schema"]
    paths = gate(spark, folder, manifest)
    df = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    return df.select(*columns) if columns else df


# ------------------------------------------------------------- commit log


def _record(spark: SparkSession, log: str, name: str, facts: dict) -> None:
    """A file that is there whole or not at all."""
    write_text(spark, f"{log}/.{name}.tmp", json.dumps(facts, sort_keys=True))
    at, fs = file_system(spark, f"{log}/.{name}.tmp")
    if not fs.rename(at, file_system(spark, f"{log}/{name}.json")[0]):
        raise FileExistsError(f"{log}/{name}.json")


def attempts(spark: SparkSession, log: str) -> list[dict]:
    """All records of a log, oldest attempt of a partition first."""
    if not any(n.endswith(".json") for n in list_files(spark, log)):
        return []
    lines = spark.read.text(f"{log}/*.json", wholetext=True).collect()
    return sorted((json.loads(r.value) for r in lines), key=lambda x: (x["partition"], x["attempt"]))


def committed(spark: SparkSession, log: str) -> dict[str, dict]:
    """The record by partition of the attempt that counts."""
    return {x["partition"]: x for x in attempts(spark, log) if x["state"] == "committed"}


def _totals(rows: DataFrame) -> dict:
    """Row count, and a content hash that does not depend on the order of rows."""
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return {"n": F.count(F.lit(1)), "digest": F.sum(content.cast("decimal(38,0)"))}


def work_off(
    spark: SparkSession,
    partitions: dict[str, str],
    load: Callable[[SparkSession, str], DataFrame],
    target: str,
    log: str,
    at_once: int = 4,
) -> dict[str, str]:
    """Partitions (name -> path) loaded, filtered by ``load`` and written; states by name: committed, kept or failed.

    Each attempt writes to a folder of its own, and only a record in the log
    makes it count, so that a run that is killed, or tasks that outlive it,
    leave nothing that readers see.  A partition that fails is recorded with
    its error and the others go on; the next run takes up what is not
    committed.  Count and hash are observed while rows are written.
    Names are plain file names.  One run at a time may use a log.
    """
    done = committed(spark, log)
    failed: dict[str, int] = {}
    for x in attempts(spark, log):
        failed[x["partition"]] = max(failed.get(x["partition"], 0), x["attempt"])

    def one(name: str) -> str:
        # A killed attempt has a folder without a record.
        started = [int(n.partition("=")[2]) for n in list_files(spark, f"{target}/{name}") if n.startswith("attempt=")]
        attempt = max([failed.get(name, 0), *started]) + 1
        facts = {"partition": name, "attempt": attempt, "source": partitions[name]}
        try:
            rows = load(spark, partitions[name])
            book = Reconciliation()
            book.watch(rows, f"{name} {attempt}", **_totals(rows)).write.parquet(f"{target}/{name}/attempt={attempt}")
            totals = book.totals()[f"{name} {attempt}"]
        except Exception as error:  # noqa: BLE001 - any fault of a partition is recorded and stays its own
            _record(spark, log, f"{name}.{attempt}", facts | {"state": "failed", "error": f"{type(error).__name__}: {str(error)[:500]}"})
            return "failed"
        _record(spark, log, f"{name}.{attempt}", facts | {"state": "committed", "rows": totals["n"], "digest": str(totals["digest"])})
        return "committed"

    todo = sorted(partitions.keys() - done.keys())
    with ThreadPoolExecutor(at_once) as pool:
        states = dict(zip(todo, pool.map(one, todo)))
    return states | {name: "kept" for name in partitions.keys() & done.keys()}


def read_committed(spark: SparkSession, target: str, log: str, schema: str, only: Iterable[str] | None = None) -> DataFrame:
    """Rows of committed partitions with their name as ``partition``; of those in ``only``, which must all be there."""
    done = committed(spark, log)
    names = sorted(done if only is None else only)
    if absent := [n for n in names if n not in done]:
        raise PartialCache(f"not committed: {', '.join(absent)}")
    paths = [f"{target}/{n}/attempt={done[n]['attempt']}" for n in names]
    if not paths:
        return spark.createDataFrame([], schema + ", partition string")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/attempt=\d+/[^/]+$", 1)
    return spark.read.schema(schema).parquet(*paths).select("*", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("partition"))


def verify_committed(spark: SparkSession, target: str, log: str, schema: str) -> None:
    """Hold counts and hashes of the log against the files, in one scan."""
    rows = read_committed(spark, target, log, schema)
    totals = _totals(rows.drop("partition"))
    found = {r["partition"]: (r["n"], str(r["digest"])) for r in rows.groupBy("partition").agg(*[c.alias(n) for n, c in totals.items()]).collect()}
    wrong = [n for n, x in committed(spark, log).items() if found.get(n, (0, "0")) != (x["rows"], x["digest"])]
    if wrong:
        raise PartialCache(f"other rows than were committed: {', '.join(sorted(wrong))}")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that holds more than this share of the rows is joined by broadcast;
#: fewer than 1 / HOT_SHARE keys can, whatever the size of the input.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) a
    temporary folder of it is made and set; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        at = spark.sparkContext.getCheckpointDir() or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _register(spark)
    return path


_registered: set[str] = set()


def _register(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _registered:
        _registered.add(app)
        atexit.register(drop_scratch, spark)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgerloom/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) to the shared folder and read it again.

    This cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hold the rows of an Arrow batch down while a plan with Python runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def inline_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's as a literal, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string, and ``more`` columns; extra columns go."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in more]
    )


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of ``left`` with ``right``, unique in ``keys``, that no hot key slows.

    ``weight`` in ``right`` is the number of rows of ``left`` with the key and
    ``total`` that of all rows.  Keys with more than HOT_SHARE of the rows (so
    fewer than 1 / HOT_SHARE of them) are broadcast; the rest is shuffled.
    ``left`` is read twice and should be a stored table.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    first = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return first.unionByName(rest.select(*first.columns))


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add ``name``: the row's place (long, from 0) within its group.

    A group may hold most of the rows, so it is ranked in two levels: rows are
    counted by (group, bucket), the counts are summed over the buckets before,
    and each (group, bucket) is ranked on its own.  The order is that of the
    bucket first, ``order`` next.  ``df`` is read twice.
    """
    b, before, n = "__bucket", "__before", "__n"
    rows = df.withColumn(b, bucket)
    counts = rows.groupBy(*groups, b).agg(F.count(F.lit(1)).alias(n))
    upto = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0))).drop(n)
    within = Window.partitionBy(*groups, b).orderBy(*order)
    placed = rows.withColumn(n, F.row_number().over(within))
    return placed.join(starts, [*groups, b]).withColumn(name, (F.col(before) + F.col(n) - 1).cast("long")).drop(b, before, n)

"""The batch operators over streams: partitions as they arrive, period assignment, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.sources.sinks import write_partitions


def read_arrivals(spark: SparkSession, folder: str, schema: str | StructType, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def filter_arrivals(arrivals: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, by: list[str], checkpoint: str) -> StreamingQuery:
    """Filter before anything is kept, and write by partition and batch; a batch that is repeated replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        write_partitions(transform(rows).withColumn("batch", F.lit(number)), target, ["batch", *by])

    return arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def assign_stream(events: DataFrame, periods: DataFrame, by: str, day: str, keys: list[str], start: str = "period_start", end: str = "period_end") -> DataFrame:
    """Stream-static join of events with the period (start, end] that holds their day; events of no period stay, without keys."""
    e, p = events.alias("e"), F.broadcast(periods).alias("p") if periods.isLocal() else periods.alias("p")
    inside = (F.col(f"e.{by}") == F.col(f"p.{by}")) & (F.col(f"e.{day}") > F.col(f"p.{start}")) & (F.col(f"e.{day}") <= F.col(f"p.{end}"))
    return e.join(p, inside, "left").select("e.*", *[F.col(f"p.{k}").alias(k) for k in keys])


def windowed_panel(events: DataFrame, time: str, keys: list[str], width: str, late: str, counts: dict) -> DataFrame:
    """Event counts by key and tumbling window with a watermark for late rows."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_events"), *[F.count_if(c).alias(n) for n, c in counts.items()])

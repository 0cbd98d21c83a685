"""Queries that read a table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import shared_folder
from ledgerloom.streaming import incremental, settling

from .tables import table


def settled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of customers, some without a day; quarters with an even order as periods, some revised to end earlier."""
    schema = table(spark, sf, "orders").schema
    # As a pattern, since a stream takes a plain path for a folder and the table may be one file.
    arrived = lambda: incremental.read_arrivals(spark, f"{sf}/orders.parquet*", schema)
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    firm, quarter = F.col("o_custkey").alias("firm"), F.trunc(day, "quarter")
    revised = F.when(k % 3 == 0, 1).otherwise(0)
    events = arrived().select(firm, k.alias("id"), F.lit(0).alias("revision"), F.when(k % 11 != 0, day).alias("day"))
    ends = F.date_sub(F.last_day(F.add_months(quarter, 2)), 20 * revised)
    periods = arrived().filter(k % 2 == 0).select(firm, F.date_format(quarter, "yyyy-MM-dd").alias("id"), revised.alias("revision"), F.date_sub(quarter, 1).alias("start"), ends.alias("end"))
    at = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    settling.write_changes(settling.settle_stream(events, periods, parts=2), f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    out = settling.latest(spark.read.parquet(f"{at}/changes"))
    return out.select(F.col("id").cast("bigint").alias("o_orderkey"), F.col("firm").cast("bigint").alias("o_custkey"), "day", "period", "status")


QUERIES = {"settled_events": settled_events}

ORACLE_SQL = {
    "settled_events": """
        WITH e AS (
            SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
        p AS (
            SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS revised
            FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
        SELECT CAST(e.o_orderkey AS BIGINT) AS o_orderkey, CAST(e.o_custkey AS BIGINT) AS o_custkey, e.day,
            strftime(p.q, '%Y-%m-%d') AS period,
            CASE WHEN e.day IS NULL THEN 'undated' WHEN p.q IS NULL THEN 'outside' ELSE 'assigned' END AS status
        FROM e LEFT JOIN p ON e.o_custkey = p.o_custkey AND CAST(date_trunc('quarter', e.day) AS DATE) = p.q
            AND e.day <= CAST(last_day(p.q + INTERVAL 2 MONTH) AS DATE) - CAST(20 * p.revised AS INTEGER)
    """,
}

"""Queries of letters: pages that are found for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import finder

from .tables import table


def letter_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Even orders as letters to customers, odd ones as pages: half of them under a longer name, a third with the customer's nation in the text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digest = F.upper(F.md5(c.cast("string").cast("binary")))
    name = F.concat(F.substring(digest, 1, 8), F.lit(" "), F.substring(digest, 9, 8)).alias("name")
    nation = table(spark, sf, "nation").select("n_nationkey", F.translate("n_name", "_#-", "   ").alias("state"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k % 600).cast("int")).alias("day")
    orders = table(spark, sf, "orders").select("o_orderkey", day, name, (c % 25).alias("n_nationkey"))
    rows = orders.join(nation, "n_nationkey")
    letters = rows.filter(k % 2 == 0).select(
        k.alias("case_id"), "day", F.array("name", F.lit(None).cast("string")).alias("names"), "state", F.lit(None).cast("string").alias("state_code"), F.lit(None).cast("array<string>").alias("aliases"),
    )
    pages = rows.filter(k % 2 == 1)
    company = F.when(k % 4 == 1, F.concat("name", F.lit(" GROUP"))).otherwise(F.col("name"))
    texts = pages.select(k.alias("page_id"), F.when(k % 3 == 0, F.concat(F.lit("Sent to "), "state", F.lit(" by mail"))).alias("text"))
    return finder.find_pages(letters, pages.select(k.alias("page_id"), F.col("day").alias("issued"), company.alias("company")), texts, days=10, least=90.0)


QUERIES = {"letter_pages": letter_pages}

#: The words of two customers have nothing in common, so only pages of the letter's own customer fit: 100 less the days apart.
ORACLE_SQL = {
    "letter_pages": """
        WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, DATE '1995-01-01' + CAST(o_orderkey % 600 AS INTEGER) AS day FROM orders),
        p AS (SELECT a.c, a.k AS case_id, a.day, b.k AS page_id, 100 - abs(a.day - b.day) AS score, b.k % 4 <> 1 AS sure, b.k % 3 = 0 AS placed
              FROM o AS a JOIN o AS b ON a.c = b.c AND a.k % 2 = 0 AND b.k % 2 = 1 AND abs(a.day - b.day) <= 10),
        l AS (SELECT c, case_id, list(struct_pack(page_id := page_id, sure := sure, placed := placed) ORDER BY score DESC, page_id) AS wishes,
                     row_number() OVER (PARTITION BY c ORDER BY min(day), case_id) AS n FROM p GROUP BY c, case_id),
        r AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS case_id, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS page_id, false AS by_place FROM l
              UNION ALL
              SELECT c, n, case_id, CASE WHEN took IS NULL THEN used ELSE list_append(used, took) END, took, NOT alone
              FROM (SELECT c, n, case_id, used, alone, CASE WHEN alone THEN free[1].page_id ELSE list_filter(free, lambda w: w.placed)[1].page_id END AS took
                    FROM (SELECT *, len(free) = 1 AND free[1].sure AS alone
                          FROM (SELECT l.c, l.n, l.case_id, r.used, list_filter(l.wishes, lambda w: NOT list_contains(r.used, w.page_id)) AS free
                                FROM r JOIN l ON l.c = r.c AND l.n = r.n + 1))))
        SELECT case_id, page_id, coalesce(by_place, true) AS by_place FROM r WHERE page_id IS NOT NULL
    """,
}

"""Queries of the listing universe: the status of issuers over time, by year, and the letters that they received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import listing

from .tables import table

FORMS = {0: "8-A12B", 1: "25", 2: "15-12G", 3: "8-A12G", 4: "S-1"}
#: Days by which the histories of customers 13n and 13n + 1 are moved: past the records' begin, past the common registration.
LATER = {0: 5479, 1: 2922}


def _moved(day: Column) -> Column:
    k = F.col("o_custkey") % 13
    return F.date_add(day.cast("date"), F.when(k == 0, LATER[0]).when(k == 1, LATER[1]).otherwise(0))


def _issuers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as issuers whose orders are filings: (o_custkey, runs) from the first filing to two years after the last."""
    o = table(spark, sf, "orders").select("o_custkey", _moved(F.col("o_orderdate")).alias("t"), (F.col("o_orderkey") % 8).alias("k"))
    form = F.lit("10-Q")
    for k, name in FORMS.items():
        form = F.when(F.col("k") == k, name).otherwise(form)
    own = o.groupBy("o_custkey").agg(
        F.collect_list(F.struct("t", form.alias("form"))).alias("events"),
        F.sort_array(F.collect_list(F.when(F.col("k") > 4, F.col("t")))).alias("periodic"),
        F.min("t").alias("first"),
        F.date_add(F.max("t"), 730).alias("last"),
    )
    c = F.col("o_custkey")
    open_end = F.when(c % 2 == 0, F.lit("1996-06-15").cast("date"))
    window = F.struct(F.lit("1995-01-01").cast("date").alias("start"), open_end.alias("end"), F.lit("NYSE").alias("exchange"))
    windows = F.when(c % 7 == 0, F.array(window))
    today = F.when(c % 2 == 0, F.array(F.lit("Nasdaq"))).otherwise(F.array().cast("array<string>"))
    status = lambda day: listing.listing_status(c % 11 != 0, F.col("events"), F.col("periodic"), windows, c % 5 != 0, today, day)
    changes = listing.change_days(F.col("events"), F.col("periodic"), windows)
    return own.select("o_custkey", listing.status_runs(F.col("first"), F.col("last"), changes, status).alias("runs"))


def listing_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Issuers and the years in which they were listed at some month end."""
    return _issuers(spark, sf).select("o_custkey", F.explode(listing.listed_years(F.col("runs"))).alias("year"))


def listing_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth order as a letter, with the status of the issuer on its day."""
    letters = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", _moved(F.col("o_orderdate")).alias("day"))
    found = letters.join(_issuers(spark, sf), "o_custkey")
    return found.select("o_orderkey", "o_custkey", "day", listing.status_on(F.col("runs"), F.col("day")).alias("status"))


def listing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Letters and listed issuers by year, as a share of the universe."""
    letters = listing_statuses(spark, sf).select("o_custkey", F.year("day").alias("year"), (F.col("status") == "YES").alias("listed"))
    return listing.yearly_summary(letters, listing_universe(spark, sf), "o_custkey")


QUERIES = {f.__name__: f for f in (listing_universe, listing_statuses, listing_summary)}

#: The status by its rules on every day of ``days``, for each of which the whole history is looked at again.
STATUS = f"""
    o AS (SELECT o_orderkey, o_custkey AS c, CAST(o_orderdate AS DATE) + CASE o_custkey % 13 WHEN 0 THEN {LATER[0]} WHEN 1 THEN {LATER[1]} ELSE 0 END AS t,
          CASE o_orderkey % 8 WHEN 0 THEN 'L' WHEN 1 THEN 'D' WHEN 2 THEN 'G' WHEN 3 THEN 'O' WHEN 4 THEN 'S' ELSE 'P' END AS k FROM orders),
    h AS (SELECT c, min(t) AS first, max(t) + 730 AS until, min(t) FILTER (k = 'P') AS first_report, count(*) FILTER (k = 'L') AS n_reg,
          coalesce(bool_or(k = 'O' AND t < DATE '2006-08-01'), false) AS early FROM o GROUP BY c),
    m AS (SELECT c, CAST(last_day(unnest(generate_series(date_trunc('month', first), date_trunc('month', until), INTERVAL 1 MONTH))) AS DATE) AS d, first, until FROM h),
    days AS (SELECT c, d FROM m WHERE d BETWEEN first AND until UNION SELECT c, t FROM o WHERE o_orderkey % 5 = 0),
    s AS (SELECT h.*, d, last, reg, latest FROM (
              SELECT days.c, d, max(t) FILTER (k = 'P') AS last, max(t) FILTER (k IN ('L', 'S')) AS reg, max(t) FILTER (k = 'L') AS latest
              FROM days LEFT JOIN o ON o.c = days.c AND t <= d GROUP BY days.c, d) JOIN h USING (c)),
    g AS (SELECT s.*, coalesce(d - reg <= 450, false) AS new,
                 EXISTS (SELECT 1 FROM o WHERE o.c = s.c AND k = 'G' AND t <= s.d AND (s.last IS NULL OR s.last - t <= 30)) AS gone,
                 latest IS NOT NULL OR early OR first <= DATE '1997-12-31' AS started, early OR first <= DATE '2006-08-01' AS old,
                 EXISTS (SELECT 1 FROM o x JOIN o y ON x.c = y.c WHERE x.c = s.c AND x.k = 'D' AND x.t <= s.d AND y.k = 'L' AND y.t > s.d AND y.t - x.t >= 180) AS apart,
                 EXISTS (SELECT 1 FROM o x JOIN o y ON x.c = y.c WHERE x.c = s.c AND x.k = 'D' AND x.t > s.latest AND x.t <= s.d AND y.k = 'P' AND y.t - x.t > 365) AS moved,
                 (SELECT min(t) FROM o WHERE o.c = s.c AND k = 'D' AND t > s.d) AS next_off, (SELECT min(t) FROM o WHERE o.c = s.c AND k = 'L' AND t > s.d) AS next_on
          FROM s),
    r AS (SELECT c, d, CASE WHEN c % 2 = 0 THEN started AND NOT (n_reg <= 3 AND apart) WHEN latest IS NOT NULL THEN NOT moved
                            ELSE old AND next_off IS NOT NULL AND (next_on IS NULL OR next_on >= next_off) END AS on_exchange,
                 first_report IS NULL OR (last IS NULL AND NOT new) OR gone OR coalesce(d - last > 460 AND NOT new, false) AS private FROM g),
    status AS (SELECT c, d, CASE WHEN c % 11 = 0 THEN 'UNCLEAR' WHEN private THEN 'NO'
                                 WHEN c % 7 = 0 THEN CASE WHEN d >= DATE '1995-01-01' AND (c % 2 <> 0 OR d < DATE '1996-06-15') THEN 'YES' ELSE 'OTC' END
                                 WHEN c % 5 <> 0 AND on_exchange THEN 'YES' ELSE 'OTC' END AS status FROM r),
    u AS (SELECT DISTINCT c, CAST(year(d) AS INT) AS year FROM status WHERE status = 'YES' AND d = last_day(d)),
    l AS (SELECT o_orderkey, c, t AS day, status FROM o JOIN status USING (c) WHERE o_orderkey % 5 = 0 AND d = t)
"""

ORACLE_SQL = {
    "listing_universe": f"WITH {STATUS} SELECT c AS o_custkey, year FROM u",
    "listing_statuses": f"WITH {STATUS} SELECT o_orderkey, c AS o_custkey, day, status FROM l",
    "listing_summary": f"""
        WITH {STATUS},
        n AS (SELECT CAST(year(day) AS INT) AS year, count(*) AS n_letters, count(*) FILTER (status = 'YES') AS n_letters_to_listed,
                     count(DISTINCT c) FILTER (status = 'YES') AS n_listed_issuers,
                     count(DISTINCT c) FILTER (status = 'YES' AND EXISTS (SELECT 1 FROM u WHERE u.c = l.c AND u.year = year(l.day))) AS n_universe_issuers FROM l GROUP BY 1),
        z AS (SELECT n.*, (SELECT count(*) FROM u WHERE u.year = n.year) AS n_universe FROM n)
        SELECT *, CASE WHEN n_universe > 0 THEN round(100 * n_universe_issuers / n_universe, 1) END AS pct_of_universe FROM z
    """,
}

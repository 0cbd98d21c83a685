"""Queries of the temporal operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import federal_fiscal_year, nearest_month_end
from ledgerloom.operators import checks, panel, temporal

from .tables import table

D = lambda c: F.col(c).cast("date")


def supplier_eras(spark: SparkSession, sf: str, overlap: bool = False) -> DataFrame:
    """Two closed year windows a supplier, split at 1998; with ``overlap`` those of suppliers of nations 0 to 4 share 1997 and 1998."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    clash = (F.col("s_nationkey") < 5) if overlap else F.lit(False)
    first = F.struct(F.col("s_nationkey").alias("firm"), F.lit(1990).alias("valid_from"), F.when(clash, 1998).otherwise(1997).alias("valid_to"))
    second = F.struct((F.col("s_nationkey") + 100).alias("firm"), F.when(clash, 1997).otherwise(1998).alias("valid_from"), F.lit(2010).alias("valid_to"))
    return s.select("s_suppkey", F.inline(F.array(first, second)))


ERAS = """
    eras AS (SELECT s_suppkey, s_nationkey AS firm, 1990 AS valid_from, CASE WHEN {clash} THEN 1998 ELSE 1997 END AS valid_to FROM supplier
             UNION ALL
             SELECT s_suppkey, s_nationkey + 100, CASE WHEN {clash} THEN 1997 ELSE 1998 END, 2010 FROM supplier)
"""
PLAIN, CLASH = ERAS.format(clash="false"), ERAS.format(clash="s_nationkey < 5")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", D("l_shipdate").alias("day"))
    return rows.withColumnRenamed("l_suppkey", "s_suppkey").withColumn("year", F.year("day"))


def validity_join(spark: SparkSession, sf: str) -> DataFrame:
    linked = temporal.validity_join(shipments(spark, sf), supplier_eras(spark, sf), "s_suppkey", "year")
    return panel.event_panel(linked, ["firm", "year"], "l_orderkey", {"n_large": F.col("l_quantity") > 25})


def validity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and firms by year under validity windows, with a total that is counted anew."""
    linked = temporal.validity_join(shipments(spark, sf), supplier_eras(spark, sf), "s_suppkey", "year")
    return panel.rollup_total(linked, "year", {"n_orders": F.countDistinct("l_orderkey"), "n_firms": F.countDistinct("firm")})


def era_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = shipments(spark, sf).groupBy("s_suppkey", "year").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"row_id": F.concat_ws("-", "s_suppkey", "year"), "firm": F.lit(-1)})
    eras = supplier_eras(spark, sf, overlap=True).filter("firm % 100 < 15")  # suppliers of other nations have none
    blocked = table(spark, sf, "supplier").filter("s_nationkey >= 20").select("s_suppkey")
    out = temporal.resolve_by_era(rows, eras, blocked, "s_suppkey", "year", "firm", "row_id")
    return out.select("s_suppkey", "year", "n", "firm")


def overlap_guard(spark: SparkSession, sf: str) -> DataFrame:
    kept = temporal.drop_conflicts(supplier_eras(spark, sf, overlap=True), "s_suppkey", "firm")
    return kept.select("s_suppkey", "firm", "valid_from", "valid_to")


def inherited_eras(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of customers as establishments that are cited with both customers' names, and the firms that they inherit."""
    o = table(spark, sf, "orders")
    k = F.floor(F.col("o_custkey") / 2)
    cited = o.select(F.when(k % 50 != 0, k.cast("string")).otherwise("").alias("fei"), F.concat(F.lit("N"), F.col("o_custkey")).alias("name_key"))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    era = lambda firm, low, high: F.struct(firm.cast("int").alias("firm"), low.cast("int").alias("valid_from"), high.cast("int").alias("valid_to"))
    eras = F.array(era(n, 1990 + c % 5, 1994 + c % 4), era(n + F.when(c % 3 == 0, 0).otherwise(100), 1996 + c % 3, F.lit(2005)))
    windows = table(spark, sf, "customer").select(F.concat(F.lit("N"), c).alias("name_key"), F.inline(eras))
    return temporal.inherited_eras(cited, windows, "fei", "name_key", "firm")


def two_route_link(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with a balance over 4000 have known ids; the others link by nation."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = shipments(spark, sf).groupBy("s_suppkey", "year").agg(F.count(F.lit(1)).alias("n")).join(s, "s_suppkey")
    known = table(spark, sf, "supplier").filter("s_acctbal > 4000").select("s_suppkey")
    by_id = temporal.era_list(supplier_eras(spark, sf).join(known, "s_suppkey").filter("valid_to < 2000"), "s_suppkey", "firm")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") + 500).alias("firm"))
    by_name = temporal.era_list(nations.withColumns({"valid_from": F.lit(1996), "valid_to": F.lit(1999)}), "s_nationkey", "firm")
    out = temporal.two_route_link(rows, by_id, by_name, "s_suppkey", "s_nationkey", "year")
    return out.select("s_suppkey", "year", "n", "link_key", "link_source")


def _events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return table(spark, sf, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


def asof_backward_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the latest earlier view of the user within a day."""
    views = _events(spark, sf, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return temporal.asof_backward(
        _events(spark, sf, "purchase"), views, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], tolerance_days=1, ties=("view_id",)
    ).select("event_id", "user_id", "view_id", "view_value")


def asof_forward_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Errors with the next purchase of the user, if it comes within three days."""
    buys = _events(spark, sf, "purchase").select(
        "user_id", F.col("ts").alias("period_end"), (F.col("ts") - F.expr("interval 3 days")).alias("period_start"), F.col("event_id").alias("buy_id")
    )
    out = temporal.assign_to_period(_events(spark, sf, "error"), buys, ["user_id"], "ts", ["buy_id"])
    return out.select("event_id", "user_id", "buy_id")


def _order_periods(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "orders").select("o_custkey", nearest_month_end(D("o_orderdate")).alias("period_end")).distinct()
    return temporal.period_starts(ends, ["o_custkey"], "period_end", [], 120, 3)


def period_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _order_periods(spark, sf).select("o_custkey", "period_end", "period_start")


def period_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments counted in the reporting periods of their customers, by customer and period."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = shipments(spark, sf).join(orders, "l_orderkey").select("o_custkey", "day")
    periods = _order_periods(spark, sf).withColumn("period", F.col("period_end"))
    placed = temporal.assign_to_period(lines, periods, ["o_custkey"], "day", ["period"])
    # Customers hardly ship twice a day, so that a count by day first would hold most of the rows in memory for nothing.
    return panel.counts_by_key(placed.withColumn("n", F.lit(1)), ["o_custkey", "period"], {"n": "n_lines"})


def fiscal_year_rate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(federal_fiscal_year(D("o_orderdate")).alias("fy")).agg(F.count(F.lit(1)).alias("n_orders"))
    lines = table(spark, sf, "lineitem").groupBy(federal_fiscal_year(D("l_shipdate")).alias("fy")).agg(F.count(F.lit(1)).alias("n_lines"))
    ratio = F.round(F.try_divide(F.lit(100.0) * F.col("n_orders"), F.col("n_lines")), 6)
    return orders.join(lines, "fy", "left").select("fy", "n_orders", "n_lines", ratio.alias("orders_per_100_lines"))


def half_open_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the customer's listing window [start, end) on their day, first window first."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    w = lambda p, a, b, x: F.struct(F.lit(p).alias("position"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end"), F.lit(x).alias("exchange"))
    windows = c.select(
        F.col("c_custkey").alias("o_custkey"), F.inline(F.array(w(1, "1996-01-01", "1998-01-01", "NYSE"), w(2, "1997-06-01", "2000-01-01", "NASDAQ"), w(3, "2000-06-01", None, "OTC")))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", D("o_orderdate").alias("day"))
    return temporal.half_open_pick(orders, windows, "o_custkey", "day", "start", "end", "position", ["exchange"], "o_orderkey").select("o_orderkey", "exchange")


def reconcile_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Panel counts against counts of events with a gap on one side: what differs."""
    e = table(spark, sf, "events")
    left = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    right = e.filter("value < 60").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile(left, right, ["user_id", "event_type"], ["n"])


def reporting_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly filings made of orders: one a customer and quarter; every third reports too near its filing."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("gvkey"), D("o_orderdate").alias("filing_date"))
    firsts = o.groupBy("gvkey", F.year("filing_date").alias("y"), F.quarter("filing_date").alias("q")).agg(F.min("filing_date").alias("filing_date"))
    lag = F.when(F.dayofyear("filing_date") % 3 == 0, 2).otherwise(40)
    filings = firsts.select("gvkey", "filing_date", F.date_sub("filing_date", lag).alias("report_date"))
    out = temporal.reporting_periods(filings)
    return out.select("gvkey", "filing_date", "period_end_imputed", "period_end", "period_start", "reporting_year", "reporting_quarter")


QUERIES = {
    f.__name__: f
    for f in (
        validity_join, validity_rollup, era_resolve, overlap_guard, inherited_eras, two_route_link, asof_backward_strict, asof_forward_interval, period_windows,
        period_assign, fiscal_year_rate, half_open_listing, reconcile_outer, reporting_periods,
    )
}

SHIP = "ships AS (SELECT l_orderkey, l_suppkey AS s_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INT) AS year FROM lineitem)"
SNAP = "CAST(CASE WHEN day({0}) <= 15 THEN last_day(CAST({0} AS DATE) - INTERVAL 1 MONTH) ELSE last_day({0}) END AS DATE)"
PERIODS = f"""
    ends AS (SELECT DISTINCT o_custkey, {SNAP.format("o_orderdate")} AS period_end FROM orders),
    lags AS (SELECT *, lag(period_end) OVER (PARTITION BY o_custkey ORDER BY period_end) AS prev FROM ends),
    periods AS (SELECT o_custkey, period_end,
                       CASE WHEN period_end - prev BETWEEN 1 AND 120 THEN prev ELSE CAST(period_end - INTERVAL 3 MONTH AS DATE) END AS period_start
                FROM lags)
"""

ORACLE_SQL = {
    "validity_join": f"""
        WITH {PLAIN}, {SHIP}
        SELECT firm, year, count(DISTINCT l_orderkey) AS n_events, count(*) FILTER (l_quantity > 25) AS n_large
        FROM ships JOIN eras USING (s_suppkey) WHERE year BETWEEN valid_from AND valid_to GROUP BY firm, year
    """,
    "validity_rollup": f"""
        WITH {PLAIN}, {SHIP}
        SELECT CASE WHEN grouping(year) = 1 THEN 'Total' ELSE CAST(year AS VARCHAR) END AS year,
               count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT firm) AS n_firms
        FROM ships JOIN eras USING (s_suppkey) WHERE year BETWEEN valid_from AND valid_to GROUP BY ROLLUP (year)
    """,
    "era_resolve": f"""
        WITH {CLASH}, {SHIP},
        rows AS (SELECT s_suppkey, year, count(*) AS n FROM ships GROUP BY ALL),
        used AS (SELECT * FROM eras WHERE firm % 100 < 15),
        blocked AS (SELECT s_suppkey FROM supplier WHERE s_nationkey >= 20),
        hits AS (SELECT r.*, u.firm, count(*) OVER (PARTITION BY r.s_suppkey, r.year) AS k
                 FROM rows r JOIN used u ON r.s_suppkey = u.s_suppkey AND r.year BETWEEN u.valid_from AND u.valid_to)
        SELECT s_suppkey, year, n, firm FROM hits WHERE k = 1 AND s_suppkey NOT IN (FROM blocked)
        UNION ALL
        SELECT s_suppkey, year, n, -1 FROM rows WHERE s_suppkey NOT IN (SELECT s_suppkey FROM used) AND s_suppkey NOT IN (FROM blocked)
    """,
    "overlap_guard": f"""
        WITH {CLASH}
        SELECT s_suppkey, firm, valid_from, valid_to FROM eras e
        WHERE NOT EXISTS (SELECT 1 FROM eras a JOIN eras b ON a.s_suppkey = b.s_suppkey AND a.firm <> b.firm
                          AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to WHERE a.s_suppkey = e.s_suppkey)
    """,
    "inherited_eras": """
        WITH w AS (SELECT c_custkey AS c, c_nationkey AS firm, 1990 + c_custkey % 5 AS low, 1994 + c_custkey % 4 AS high FROM customer
                   UNION ALL SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 100 END, 1996 + c_custkey % 3, 2005 FROM customer),
        sound AS (SELECT * FROM w WHERE c NOT IN (SELECT a.c FROM w a JOIN w b ON a.c = b.c AND a.firm <> b.firm AND a.low <= b.high AND b.low <= a.high)),
        cited AS (SELECT DISTINCT o_custkey AS c, o_custkey // 2 AS fei FROM orders WHERE (o_custkey // 2) % 50 <> 0),
        i AS (SELECT DISTINCT fei, firm, low, high FROM cited JOIN sound USING (c)),
        kept AS (SELECT * FROM i WHERE fei NOT IN (SELECT a.fei FROM i a JOIN i b ON a.fei = b.fei AND a.firm <> b.firm AND a.low <= b.high AND b.low <= a.high)),
        years AS (SELECT DISTINCT fei, firm, unnest(range(low, high + 1)) AS y FROM kept),
        runs AS (SELECT fei, firm, y, y - row_number() OVER (PARTITION BY fei, firm ORDER BY y) AS run FROM years)
        SELECT CAST(fei AS VARCHAR) AS fei, firm, CAST(min(y) AS INT) AS valid_from, CAST(max(y) AS INT) AS valid_to FROM runs GROUP BY fei, firm, run
    """,
    "two_route_link": f"""
        WITH {PLAIN}, {SHIP},
        rows AS (SELECT s_suppkey, year, count(*) AS n FROM ships GROUP BY ALL),
        linked AS (
            SELECT r.*, s.s_nationkey, s.s_acctbal > 4000 AS known,
                   CASE WHEN s.s_acctbal > 4000
                        THEN (SELECT min(firm) FROM eras e WHERE e.s_suppkey = r.s_suppkey AND e.valid_to < 2000 AND r.year BETWEEN e.valid_from AND e.valid_to)
                        ELSE CASE WHEN r.year BETWEEN 1996 AND 1999 THEN s.s_nationkey + 500 END END AS link_key
            FROM rows r JOIN supplier s USING (s_suppkey))
        SELECT s_suppkey, year, n, link_key,
               CASE WHEN link_key IS NULL THEN NULL WHEN known THEN 'fei_exact' ELSE 'name_normalized' END AS link_source
        FROM linked
    """,
    "asof_backward_strict": """
        WITH v AS (SELECT user_id, ts AS view_ts, max(event_id) AS view_id, max_by(value, event_id) AS view_value
                   FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
        SELECT p.event_id, p.user_id,
               CASE WHEN p.ts - v.view_ts <= INTERVAL 1 DAY THEN v.view_id END AS view_id,
               CASE WHEN p.ts - v.view_ts <= INTERVAL 1 DAY THEN v.view_value END AS view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.view_ts
    """,
    "asof_forward_interval": """
        WITH b AS (SELECT user_id, ts AS period_end, min(event_id) AS buy_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
        SELECT e.event_id, e.user_id, CASE WHEN e.ts > b.period_end - INTERVAL 3 DAY THEN b.buy_id END AS buy_id
        FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts <= b.period_end
    """,
    "period_windows": f"WITH {PERIODS} SELECT o_custkey, period_end, period_start FROM periods",
    "period_assign": f"""
        WITH {PERIODS}, {SHIP},
        lines AS (SELECT o_custkey, day, count(*) AS n FROM ships JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        hit AS (SELECT l.*, p.period_end AS period, p.period_start FROM lines l ASOF JOIN periods p ON l.o_custkey = p.o_custkey AND l.day <= p.period_end)
        SELECT o_custkey, period, CAST(sum(n) AS BIGINT) AS n_lines FROM hit WHERE day > period_start GROUP BY o_custkey, period
    """,
    "fiscal_year_rate": """
        WITH o AS (SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fy, count(*) AS n_orders FROM orders GROUP BY 1),
        l AS (SELECT CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fy, count(*) AS n_lines FROM lineitem GROUP BY 1)
        SELECT fy, n_orders, n_lines, round(100.0 * n_orders / n_lines, 6) AS orders_per_100_lines FROM o LEFT JOIN l USING (fy)
    """,
    "half_open_listing": """
        SELECT o_orderkey,
               CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') THEN NULL
                    WHEN CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'NYSE'
                    WHEN CAST(o_orderdate AS DATE) >= DATE '1997-06-01' AND CAST(o_orderdate AS DATE) < DATE '2000-01-01' THEN 'NASDAQ'
                    WHEN CAST(o_orderdate AS DATE) >= DATE '2000-06-01' THEN 'OTC' END AS exchange
        FROM orders
    """,
    "reconcile_outer": """
        WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
        b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 60 GROUP BY ALL)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.n AS left_n, b.n AS right_n
        FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.n IS DISTINCT FROM b.n
    """,
    "reporting_periods": f"""
        WITH firsts AS (SELECT o_custkey AS gvkey, min(CAST(o_orderdate AS DATE)) AS filing_date FROM orders GROUP BY o_custkey, year(o_orderdate), quarter(o_orderdate)),
        f AS (SELECT *, filing_date - CASE WHEN dayofyear(filing_date) % 3 = 0 THEN 2 ELSE 40 END AS report_date FROM firsts),
        m AS (SELECT *, filing_date - report_date < 8 AS imp FROM f),
        s AS (SELECT gvkey, month({SNAP.format("report_date")}) % 3 AS c, count(*) AS k FROM m WHERE NOT imp GROUP BY ALL),
        y AS (SELECT gvkey, c FROM s QUALIFY row_number() OVER (PARTITION BY gvkey ORDER BY k DESC, c) = 1),
        j AS (SELECT m.*, coalesce(y.c, 0) AS c, filing_date - 20 AS lim FROM m LEFT JOIN y USING (gvkey)),
        b AS (SELECT *, CAST(CASE WHEN lim = last_day(lim) THEN lim ELSE last_day(CAST(lim - INTERVAL 1 MONTH AS DATE)) END AS DATE) AS base FROM j),
        e AS (SELECT gvkey, filing_date, imp,
                     CASE WHEN NOT imp THEN report_date
                          WHEN month(base) % 3 = c THEN base
                          WHEN month(last_day(CAST(base - INTERVAL 1 MONTH AS DATE))) % 3 = c THEN last_day(CAST(base - INTERVAL 1 MONTH AS DATE))
                          ELSE last_day(CAST(base - INTERVAL 2 MONTH AS DATE)) END AS period_end FROM b),
        p AS (SELECT *, lag(period_end) OVER (PARTITION BY gvkey ORDER BY period_end, filing_date) AS prev, {SNAP.format("period_end")} AS lab FROM e)
        SELECT gvkey, filing_date, imp AS period_end_imputed, period_end,
               CASE WHEN period_end - prev BETWEEN 1 AND 120 THEN prev ELSE CAST(period_end - INTERVAL 3 MONTH AS DATE) END AS period_start,
               CAST(year(lab) AS INT) AS reporting_year, CAST(quarter(lab) AS INT) AS reporting_quarter
        FROM p
    """,
}

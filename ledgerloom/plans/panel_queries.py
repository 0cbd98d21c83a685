"""Queries of the panel, ranking and record operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_ends
from ledgerloom.operators import panel, ranking

from .tables import table

D = lambda c: F.col(c).cast("date")
KINDS = ["signup", "error", "click", "view", "purchase"]


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", D("ts"))


def firm_year_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.event_panel(
        _daily(spark, sf), ["user_id", "day", "event_type"], "event_id", {"n_high": F.col("value") > 20, "n_low": F.col("value") <= 5}
    )


def panel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = panel.event_panel(_daily(spark, sf), ["user_id", "day", "event_type"], None, {})
    return panel.pivot_counts(p, ["user_id", "day"], "event_type", "n_events", KINDS)


def panel_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return panel.cooccurrence(panel_pivot(spark, sf), KINDS)


def active_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Panel rows of users and days with a purchase or signup."""
    daily = _daily(spark, sf)
    p = panel.event_panel(daily, ["user_id", "day", "event_type"], None, {})
    return panel.active_gate(p, daily.filter(F.col("event_type").isin("purchase", "signup")), ["user_id", "day"])


def active_flag(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily(spark, sf)
    p = panel.event_panel(daily, ["user_id", "day"], None, {})
    return panel.active_flag(p, daily.filter("event_type = 'purchase'"), ["user_id", "day"])


def rollup_total(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return panel.rollup_total(o, "year", {"n_orders": F.count(F.lit(1)), "n_customers": F.countDistinct("o_custkey")})


def two_totals(spark: SparkSession, sf: str) -> DataFrame:
    return panel.two_totals(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_custkey")


def recipient_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _daily(spark, sf).withColumns({"is_buy": F.col("event_type") == "purchase", "is_error": F.col("event_type") == "error"})
    return panel.entity_summary(e, "user_id", "event_id", "day", ["is_buy", "is_error"], "event_type")


def quantile_table(spark: SparkSession, sf: str) -> DataFrame:
    q = panel.quantile_table(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return q.select("l_returnflag", "n", *[F.bround(c, 4).alias(c) for c in q.columns[2:]])


def universe_share(spark: SparkSession, sf: str) -> DataFrame:
    """Latest order value of each customer, its share by market segment."""
    last = ranking.keep_first(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    s = panel.share_of_total(last.join(c, "o_custkey"), "c_mktsegment", "o_totalprice")
    return s.select("c_mktsegment", "n", F.round("total", 2).alias("total"), F.round("pct", 6).alias("pct"))


def first_last_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_and_last(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


def dense_rank_copies(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ranked = ranking.dense_rank_of(o, "o_orderpriority", "rank")
    return ranking.copy_number(ranked, ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "rank", "copy")


def keep_unshared(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", D("o_orderdate").alias("day"))
    months = o.withColumn("month", F.trunc("day", "month"))
    return ranking.keep_unshared(months, ["o_custkey", "month"]).select("o_orderkey", "o_custkey", "month")


def mode_per_group(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate") % 3)
    return panel.mode_per_group(o, ["o_custkey"], F.col("m"), "cycle")


def event_vs_noevent_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of good documents with and without a URL, a digit and a license word."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    marked = d.select(
        "quality",
        t.contains("###").cast("int").alias("symbols"),
        t.contains("@").cast("int").alias("mail"),
        t.contains("License").cast("int").alias("license"),
        (F.col("n_chars") > 500).alias("long"),
    )
    rates = panel.event_rates(marked, ["symbols", "mail", "license"], {"symbols": "quality", "mail": "quality", "license": "quality"}, {"license": F.col("long")})
    return rates.select("event", "has_event", "n_rows", "n_outcome", F.round("rate", 6).alias("rate"))


def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rule = (~F.col("text").contains("###")).cast("int")
    a = panel.agreement_rate(d, ["lang"], rule == F.col("quality"))
    return a.select("lang", "n", F.round("rate", 6).alias("rate"))


def top_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent part names of shipments that no small part carries."""
    p = table(spark, sf, "part")
    known = p.filter("p_size <= 3").select("p_name").distinct()
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    missed = lines.join(p.select("p_partkey", "p_name"), "p_partkey").join(known, "p_name", "left_anti")
    return panel.top_counts(missed, "p_name", 20)


def group_verdict(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    ladder = [("urgent_open", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")), ("pending", F.col("o_orderstatus") == "P"), ("large", F.col("o_totalprice") > 300000)]
    return panel.group_verdict(o, "o_custkey", ladder, "plain")


def month_end_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and month ends between their first and last order at which the last order is at most 90 days old."""
    o = table(spark, sf, "orders").select("o_custkey", D("o_orderdate").alias("day"))
    spans = o.groupBy("o_custkey").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.collect_set("day").alias("days"))
    ends = spans.withColumn("month_end", F.explode(month_ends(F.col("a"), F.col("b"))))
    alive = F.exists("days", lambda d: (d <= F.col("month_end")) & (F.datediff(F.col("month_end"), d) <= 90))
    return ends.filter(alive).select("o_custkey", "month_end")


def choose_one(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = o.select(
        "o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("printed"), (F.col("o_orderkey") % 13).alias("gap"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 50 + 50.0).alias("score"), (F.col("o_orderpriority") < "3").alias("live"),
    )
    return ranking.choose_one(c, "o_custkey", "printed", "gap", "score", "live", "o_orderkey").select("o_custkey", "o_orderkey", "n_acceptable")


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    new = o.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    return ranking.upsert(o, new, ["o_orderkey"])


def banded_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's purchases and errors within three days: counts by user."""
    e = _daily(spark, sf).select("user_id", "event_id", "event_type", "day")
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), F.col("day").alias("d1"))
    b = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("err"), F.col("day").alias("d2"))
    near = ranking.banded_candidates(a, b, "d1", "d2", 3, ["user_id"])
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"))


def neighbour_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the order values around a day of each supplier's."""
    c = table(spark, sf, "supplier").select("s_suppkey", F.date_add(F.lit("1995-06-01").cast("date"), F.floor("s_acctbal").cast("int") % 2000).alias("day"))
    o = table(spark, sf, "orders").select(D("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    out = ranking.neighbour_bounds(c, o, "s_suppkey", "day", "v")
    return out.select("s_suppkey", "band", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def greedy_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases take the nearest free error of the same user, in time order."""
    e = _daily(spark, sf).select("user_id", "event_id", "event_type", "day")
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), F.col("day").alias("d1"))
    b = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("err"), F.col("day").alias("d2"))
    pairs = ranking.banded_candidates(a, b, "d1", "d2", 3, ["user_id"])
    scored = pairs.withColumns({"score": (100 - F.abs(F.datediff("d1", "d2"))).cast("double"), "at": F.datediff("d1", F.lit("2024-01-01").cast("date"))})
    return ranking.greedy_assignment(scored, "user_id", "buy", "err", "at", "score")


QUERIES = {
    f.__name__: f
    for f in (
        firm_year_panel, panel_pivot, panel_cooccurrence, active_gate, active_flag, rollup_total, two_totals, recipient_summary, quantile_table,
        universe_share, first_last_per_key, dense_rank_copies, keep_unshared, mode_per_group, event_vs_noevent_rates, agreement_rate, top_misses,
        group_verdict, month_end_universe, choose_one, upsert_merge, banded_candidates, neighbour_bounds, greedy_assignment,
    )
}

DAILY = "e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)"
PIVOT = ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS)
RATE = """
    SELECT '{e}' AS event, '{w}' AS has_event, count(*) FILTER ({c}) AS n_rows, count(*) FILTER ({c} AND quality > 0) AS n_outcome,
           round(count(*) FILTER ({c} AND quality > 0) / nullif(count(*) FILTER ({c}), 0), 6) AS rate FROM d
"""


def _rates() -> str:
    rules = {"symbols": ("contains(text, '###')", "true"), "mail": ("contains(text, '@')", "true"), "license": ("contains(text, 'License')", "n_chars > 500")}
    parts = [RATE.format(e=e, w=w, c=f"({seen}) AND {neg}({has})") for e, (has, seen) in rules.items() for w, neg in (("with", ""), ("without", "NOT "))]
    return "WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)) " + " UNION ALL ".join(parts)


ORACLE_SQL = {
    "firm_year_panel": f"""
        WITH {DAILY} SELECT user_id, day, event_type, count(DISTINCT event_id) AS n_events, count(*) FILTER (value > 20) AS n_high,
        count(*) FILTER (value <= 5) AS n_low FROM e GROUP BY user_id, day, event_type
    """,
    "panel_pivot": f"WITH {DAILY} SELECT user_id, day, {PIVOT} FROM e GROUP BY user_id, day",
    "panel_cooccurrence": f"""
        WITH {DAILY}, w AS (SELECT user_id, day, {PIVOT} FROM e GROUP BY user_id, day)
        SELECT coalesce(nullif(concat_ws('+', {", ".join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in KINDS)}), ''), 'none') AS pattern, count(*) AS n_rows
        FROM w GROUP BY 1
    """,
    "active_gate": f"""
        WITH {DAILY} SELECT user_id, day, event_type, count(*) AS n_events FROM e
        WHERE EXISTS (SELECT 1 FROM e a WHERE a.user_id = e.user_id AND a.day = e.day AND a.event_type IN ('purchase', 'signup'))
        GROUP BY user_id, day, event_type
    """,
    "active_flag": f"WITH {DAILY} SELECT user_id, day, count(*) AS n_events, bool_or(event_type = 'purchase') AS is_active FROM e GROUP BY user_id, day",
    "rollup_total": """
        SELECT CASE WHEN grouping(y) = 1 THEN 'Total' ELSE CAST(y AS VARCHAR) END AS year, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
        FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (y)
    """,
    "two_totals": """
        WITH g AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)
        SELECT * FROM g UNION ALL SELECT 'Sum of groups', CAST(sum(n) AS BIGINT) FROM g UNION ALL SELECT 'Unique', count(DISTINCT o_custkey) FROM orders
    """,
    "recipient_summary": f"""
        WITH {DAILY} SELECT user_id, count(DISTINCT event_id) AS n_events, min(day) AS first_day, max(day) AS last_day,
        bool_or(event_type = 'purchase') AS any_is_buy, bool_or(event_type = 'error') AS any_is_error,
        string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS labels FROM e GROUP BY user_id
    """,
    "quantile_table": """
        SELECT l_returnflag, count(l_extendedprice) AS n, round_even(avg(l_extendedprice), 4) AS mean, round_even(median(l_extendedprice), 4) AS median,
               round_even(stddev_samp(l_extendedprice), 4) AS sd, round_even(min(l_extendedprice), 4) AS min, round_even(max(l_extendedprice), 4) AS max,
               round_even(quantile_cont(l_extendedprice, 0.10), 4) AS p10, round_even(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
               round_even(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round_even(quantile_cont(l_extendedprice, 0.90), 4) AS p90
        FROM lineitem GROUP BY l_returnflag
    """,
    "universe_share": """
        WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
        s AS (SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM l JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT c_mktsegment, n, round(total, 2) AS total, round(100 * total / sum(total) OVER (), 6) AS pct FROM s
    """,
    "first_last_per_key": """
        SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_o_orderkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey,
               min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus
        FROM orders GROUP BY o_custkey
    """,
    "dense_rank_copies": """
        SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority DESC) AS INT) AS rank,
               CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS INT) AS copy FROM orders
    """,
    "keep_unshared": """
        WITH m AS (SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
        SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY o_custkey, month) = 1
    """,
    "mode_per_group": """
        WITH g AS (SELECT o_custkey, CAST(month(o_orderdate) % 3 AS INT) AS cycle, count(*) AS n FROM orders GROUP BY ALL)
        SELECT o_custkey, cycle FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, cycle) = 1
    """,
    "event_vs_noevent_rates": _rates(),
    "agreement_rate": """
        SELECT lang, count(*) AS n, round(avg(CASE WHEN (NOT contains(text, '###'))::INT = quality THEN 1.0 ELSE 0.0 END), 6) AS rate
        FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """,
    "top_misses": """
        SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 3) GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20
    """,
    "group_verdict": """
        SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') THEN 'urgent_open' WHEN bool_or(o_orderstatus = 'P') THEN 'pending'
               WHEN bool_or(o_totalprice > 300000) THEN 'large' ELSE 'plain' END AS verdict FROM orders GROUP BY o_custkey
    """,
    "month_end_universe": """
        WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
        m AS (SELECT o_custkey, a, b, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM s)
        SELECT o_custkey, month_end FROM m WHERE month_end BETWEEN a AND b
        AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = m.o_custkey AND CAST(o_orderdate AS DATE) <= month_end AND month_end - CAST(o_orderdate AS DATE) <= 90)
    """,
    "choose_one": """
        WITH c AS (SELECT *, o_orderstatus = 'F' AS printed, o_orderkey % 13 AS gap, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 50 + 50.0 END AS score,
                          o_orderpriority < '3' AS live FROM orders)
        SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_acceptable FROM c
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY printed DESC, gap, coalesce(score, 100) DESC, live DESC, o_orderkey) = 1
    """,
    "upsert_merge": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "banded_candidates": f"""
        WITH {DAILY} SELECT a.user_id, count(*) AS n_pairs FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.day - b.day) <= 3
        WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY a.user_id
    """,
    "greedy_assignment": f"""
        WITH RECURSIVE {DAILY},
        p AS (SELECT a.user_id, a.event_id AS buy, a.day AS d1, b.event_id AS err, CAST(100 - abs(a.day - b.day) AS DOUBLE) AS score
              FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(a.day - b.day) <= 3),
        l AS (SELECT user_id, buy, list(struct_pack(err := err, score := score) ORDER BY score DESC, err) AS wishes,
                     row_number() OVER (PARTITION BY user_id ORDER BY min(d1), buy) AS k FROM p GROUP BY user_id, buy),
        r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS buy, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(err BIGINT, score DOUBLE)) AS took FROM l
              UNION ALL
              SELECT user_id, k, buy, CASE WHEN took IS NULL THEN used ELSE list_append(used, took.err) END, took
              FROM (SELECT l.user_id, l.k, l.buy, r.used, list_filter(l.wishes, lambda w: NOT list_contains(r.used, w.err))[1] AS took
                    FROM r JOIN l ON l.user_id = r.user_id AND l.k = r.k + 1))
        SELECT user_id, buy, took.err AS err, took.score AS score FROM r WHERE took IS NOT NULL
    """,
    "neighbour_bounds": """
        WITH c AS (SELECT s_suppkey, DATE '1995-06-01' + CAST(floor(s_acctbal) AS INT) % 2000 AS day FROM supplier),
        o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
        p AS (SELECT s_suppkey, abs(c.day - o.day) AS gap, v FROM c JOIN o ON abs(c.day - o.day) <= 30),
        q AS (SELECT s_suppkey, k AS band, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM p, (SELECT unnest([3, 7, 15, 30]) AS k)
              WHERE gap <= k GROUP BY s_suppkey, k HAVING count(*) >= 8),
        b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY band) = 1)
        SELECT c.s_suppkey, band, round(low, 4) AS low, round(high, 4) AS high FROM c LEFT JOIN b USING (s_suppkey)
    """,
}

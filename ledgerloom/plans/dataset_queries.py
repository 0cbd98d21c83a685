"""Queries of the composed datasets, the listing rules and the small functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, texts
from ledgerloom.operators import listing, temporal

from . import composites
from .tables import table

D = lambda c: F.col(c).cast("date")


def market_value(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer's largest order of an earlier year as price, if that year is not too long ago."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("gvkey"), "o_orderkey", D("o_orderdate").alias("action_taken_date"), "o_totalprice")
    known = o.groupBy("gvkey", F.make_date(F.year("action_taken_date"), F.lit(12), F.lit(31)).alias("datadate"))
    known = known.agg(F.max("o_totalprice").alias("prcc_f"), F.count(F.lit(1)).cast("double").alias("csho"))
    out = composites.attach_market_value(o.drop("o_totalprice"), known)
    return out.select("o_orderkey", F.round("mktcap", 2).alias("mktcap"), "fundamentals_date", "has_mktcap")


def _recalls(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf, "orders").join(c, "o_custkey")
    day = D("o_orderdate")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("000"), F.col("o_custkey") + 7, F.lit(".0")).alias("firm_fei_number"),
        F.concat("c_name", F.lit(", Inc.")).alias("recalling_firm"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_format(day, "M/d/yyyy")).alias("event_date_initiated"),
        F.date_format(day, "yyyy-MM-dd").alias("event_date_posted"),
    )


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Recalls linked by establishment for every third customer, by name for every fifth, each until the end of 1996."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    era = lambda k: F.array(F.struct(F.lit(1900).alias("low"), F.lit(1996).alias("high"), k.alias("key")))
    by_id = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 7).cast("string").alias("fei"), era(F.col("c_custkey")).alias("eras"))
    by_name = c.filter("c_custkey % 5 = 0").select(names.normalize_name(F.concat("c_name", F.lit(", Inc."))).alias("name_key"), era(F.col("c_custkey")).alias("eras"))
    return composites.link_recalls(_recalls(spark, sf), by_id, by_name)


def recall_links(spark: SparkSession, sf: str) -> DataFrame:
    return _linked(spark, sf).select("o_orderkey", "fei", "event_date", "year", "link_key", "link_source")


def recall_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return composites.unlinked_worklist(_linked(spark, sf))


def panel_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, purchases and clicks of users by day as letters, recalls and adverse events of firms by year."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("gvkey"), F.dayofyear("ts").alias("year"), "event_id", "event_type", "value")
    letters = e.filter("event_type = 'error'").withColumnRenamed("event_id", "case_id")
    recalls = e.filter("event_type = 'purchase'").select(
        "gvkey", "year", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("cfres_id"),
        F.when(F.col("value") > 20, "Class I").when(F.col("value") > 5, "Class II").otherwise("Class III").alias("classification"),
    )
    adverse = e.filter("event_type = 'click'").withColumn("link_tier", F.when(F.col("value") > 10, "A_exact").otherwise("B_prefix"))
    active = e.filter("event_type IN ('signup', 'view')").select("gvkey", "year")
    master = e.select("gvkey").distinct().filter("gvkey % 4 <> 0")
    master = master.selectExpr("gvkey", "concat('Firm ', gvkey) AS conm", "CAST(2800 + gvkey % 1100 AS STRING) AS sic", "'A' AS costat", "gvkey + 5 AS cik")
    return composites.firm_year_panel(letters, recalls, adverse, active, master)


#: Sentences of filings; a document gets some of them by its number.
SENTENCES = (
    "Item 8.01 Other Events. The company received a Warning Letter from the FDA about 21 CFR Part 820. ",
    "A voluntary recall of infusion pumps was announced; corrections and removals follow. ",
    "Adverse event reports on the catheter and its tablets were filed under the BLA. ",
    "Item 9.01 Exhibits. Class II recall of vials, an NDA and an untitled letter. ",
    "Nothing of note. ",
)


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(*[F.when(F.col("doc_id") % k == 0, F.lit(s)).otherwise("") for k, s in zip((2, 3, 5, 7, 11), SENTENCES)])
    sic = F.when(F.col("doc_id") % 4 == 0, "3841").when(F.col("doc_id") % 4 == 1, "2834").otherwise("7372")
    return table(spark, sf, "documents").select("doc_id", sic.alias("sic"), F.concat(head, "text").alias("text"))


CLASSES = ["n_flags", "n_flags_incl_untitled", "has_fda_context", "product_domain", "is_device_domain", "lead_source", "doc_chars"]


def filing_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with the regulatory vocabularies: event flags, domains, lead."""
    out = composites.classify_filings(_filings(spark, sf))
    flags = [f"{w}_{e}" for e in texts.EVENT_PHRASES for w in ("flag", "body_mentions")]
    hits = [f"domain_{d}_{w}" for d in texts.DOMAIN_TERMS for w in ("hits", "lead_hits")]
    return out.select("doc_id", F.md5("lead").alias("lead_md5"), *CLASSES, *flags, *[F.col(h).cast("long").alias(h) for h in hits])


def device_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Filings about a device by their text, or by industry where the text does not tell."""
    out = composites.device_set(composites.classify_filings(_filings(spark, sf)))
    return out.select("doc_id", "sic_bucket", "device_evidence")


def listing_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' histories of orders as filings, and their listing on the middle of 1996."""
    o = table(spark, sf, "orders").select("o_custkey", D("o_orderdate").alias("t"), (F.col("o_orderkey") % 8).alias("k"))
    form = F.when(F.col("k") == 0, "8-A12B").when(F.col("k") == 1, "25").when(F.col("k") == 2, "15-12G").when(F.col("k") == 3, "8-A12G").when(F.col("k") == 4, "S-1").otherwise("10-Q")
    own = o.groupBy("o_custkey").agg(
        F.collect_list(F.struct("t", form.alias("form"))).alias("events"), F.sort_array(F.collect_list(F.when(F.col("k") > 4, F.col("t")))).alias("periodic")
    )
    windows = F.when(F.col("o_custkey") % 7 == 0, F.array(F.struct(F.lit("1995-01-01").cast("date").alias("start"), F.lit("1996-06-15").cast("date").alias("end"), F.lit("NYSE").alias("exchange"))))
    today = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("Nasdaq"))).otherwise(F.array().cast("array<string>"))
    v = listing.listing_verdict(F.lit(True), F.col("events"), F.col("periodic"), windows, F.col("o_custkey") % 5 != 0, today, F.lit("1996-06-15").cast("date"))
    return own.select("o_custkey", v.alias("v")).select("o_custkey", "v.*")


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and other small functions on names."""
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" & ")), F.lit(" /DE/ Co., Inc."))
    spaced = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t x  "))
    listed = F.array(F.when(F.col("c_custkey") % 2 == 0, F.lit("a")), F.lit("b"), F.when(F.col("c_custkey") % 3 == 0, F.lit("c")))
    return c.select(
        "c_custkey",
        names.collapse(spaced).alias("collapsed"),
        names.joined(listed).alias("joined"),
        F.get(listed, 0).alias("first_listed"),
        F.coalesce(F.size(F.when(F.col("c_custkey") % 5 != 0, listed)), F.lit(0)).alias("n_listed"),
        texts.without_archive_mark(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(" [ARCHIVED] ")).otherwise(""))).alias("unarchived"),
        F.length(names.normalize_name(raw)).alias("n_normalized"),
    )


def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as text in two formats and unreadable ones, fiscal positions and gaps."""
    o = table(spark, sf, "orders").select("o_orderkey", D("o_orderdate").alias("day"))
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("day", "M/d/yyyy")).when(k == 1, F.date_format("day", "yyyy-MM-dd")).otherwise("13/45/99x")
    parsed = dates.parse_date(written)
    known = temporal.in_window_or_unknown(F.year(parsed), F.lit(1993), F.lit(1995))
    return o.select(
        "o_orderkey",
        parsed.alias("parsed"),
        F.round(dates.fiscal_position(F.col("day")), 6).alias("fiscal_position"),
        dates.day_gap(F.col("day"), F.lit("1995-01-01").cast("date")).alias("gap"),
        known.alias("in_window_or_unknown"),
        F.last_day(F.add_months(F.last_day("day"), -3)).alias("three_back"),
    )


def title_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Title lines 'Company m/d/yy' of letters."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Clerk "), "o_custkey").alias("clerk"), D("o_orderdate").alias("day"))
    long = F.col("o_orderkey") % 2 == 0
    when = F.when(long, F.date_format("day", "M/d/yyyy")).otherwise(F.date_format(F.add_months("day", 144), "M/d/yy"))
    text = F.concat("clerk", F.lit(" Ltd "), when, F.lit("\nbody 1/1/1999"))
    return o.select("o_orderkey", texts.title_line(text).alias("x"), texts.recipient(text, F.lit(None).cast("string")).alias("recipient")).select("o_orderkey", "x.*", "recipient")


QUERIES = {
    f.__name__: f
    for f in (market_value, recall_links, recall_worklist, panel_dataset, filing_classes, device_filings, listing_verdicts, name_keys, date_parts, title_lines)
}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


HEAD = " || ".join(f"CASE WHEN doc_id % {k} = 0 THEN '{_quoted(s)}' ELSE '' END" for k, s in zip((2, 3, 5, 7, 11), SENTENCES))
FILED = f"""
    f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3841' WHEN 1 THEN '2834' ELSE '7372' END AS sic, {HEAD} || text AS text FROM documents),
    p AS (SELECT *, regexp_split_to_array(text, '(?i)item\\s+[0-9]+\\.[0-9]+') AS gaps, regexp_extract_all(text, '(?i)item\\s+[0-9]+\\.[0-9]+') AS found FROM f),
    q AS (SELECT *, [list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(h) for h in found[1:i - 1]]), 0) for i in range(1, len(found) + 1)] AS starts FROM p),
    l AS (SELECT *, CASE WHEN len(found) > 0 THEN array_to_string([substr(text, CAST(x AS BIGINT) + 1, 500) for x in starts], ' ') ELSE substr(text, 1, 1000) END AS lead FROM q),
    h AS (SELECT *, {", ".join(f"len(regexp_extract_all(text, '{p}')) AS domain_{d}_hits, len(regexp_extract_all(lead, '{p}')) AS domain_{d}_lead_hits" for d, p in texts.DOMAIN_TERMS.items())},
          regexp_matches(text, '{texts.REGULATOR}') AS has_fda_context FROM l),
    g AS (SELECT *, greatest(domain_device_hits, domain_drug_hits, domain_biologic_hits) AS most,
          {", ".join(f"CAST(regexp_matches(lead, '{p}') AND has_fda_context AS INT) AS flag_{e}, CAST(regexp_matches(text, '{p}') AS INT) AS body_mentions_{e}" for e, p in texts.EVENT_PHRASES.items())} FROM h),
    r AS (SELECT *, CASE WHEN most = 0 THEN 'unspecified' {" ".join(
        f"WHEN domain_{d}_hits = most AND " + " AND ".join(f"NOT (domain_{o}_hits > 0 AND most - domain_{o}_hits <= 1)" for o in texts.DOMAIN_TERMS if o != d) + f" THEN '{d}'"
        for d in texts.DOMAIN_TERMS)} ELSE 'mixed' END AS product_domain,
          flag_warning_letter + flag_adverse_event + flag_recall AS n_flags FROM g)
"""
RECALLS = """
    r AS (SELECT o_orderkey, o_custkey, c_name, CAST(o_orderdate AS DATE) AS event_date, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey),
    k AS (SELECT *, CASE WHEN (o_custkey % 3 = 0 OR o_custkey % 5 = 0) AND year <= 1996 THEN o_custkey END AS link_key FROM r)
"""
SIDE = "SELECT gvkey, year, '{e}' AS event_type, {n} AS n_events, {c} FROM e WHERE {w} GROUP BY gvkey, year"

ORACLE_SQL = {
    "market_value": """
        WITH e AS (SELECT o_custkey AS gvkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
        f AS (SELECT o_custkey AS gvkey, make_date(year(o_orderdate), 12, 31) AS datadate, max(o_totalprice) * count(*) AS m FROM orders GROUP BY 1, 2),
        j AS (SELECT o_orderkey, d, datadate, m FROM e ASOF LEFT JOIN f ON e.gvkey = f.gvkey AND e.d > f.datadate)
        SELECT o_orderkey, CASE WHEN d - datadate <= 547 THEN round(m, 2) END AS mktcap, CASE WHEN d - datadate <= 547 THEN datadate END AS fundamentals_date,
               coalesce(d - datadate <= 547, false) AS has_mktcap FROM j
    """,
    "recall_links": f"""
        WITH {RECALLS} SELECT o_orderkey, CAST(o_custkey + 7 AS VARCHAR) AS fei, event_date, CAST(year AS INT) AS year, link_key,
        CASE WHEN link_key IS NULL THEN NULL WHEN o_custkey % 3 = 0 THEN 'fei_exact' ELSE 'name_normalized' END AS link_source FROM k
    """,
    "recall_worklist": f"""
        WITH {RECALLS} SELECT trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS name_key, count(*) AS n_recalls, min(event_date) AS first_date, max(event_date) AS last_date
        FROM k WHERE link_key IS NULL GROUP BY 1
    """,
    "panel_dataset": f"""
        WITH e AS (SELECT user_id AS gvkey, CAST(dayofyear(ts) AS INT) AS year, event_id, event_type, value FROM events),
        a AS ({SIDE.format(e="warning_letter", n="count(DISTINCT event_id)", w="event_type = 'error'", c="NULL::BIGINT AS n_recall_class_i, NULL::BIGINT AS n_recall_class_ii, NULL::BIGINT AS n_recall_class_iii, NULL::BIGINT AS n_mdr_tier_a, NULL::BIGINT AS n_mdr_tier_b")}
              UNION ALL {SIDE.format(e="recall", n="count(DISTINCT event_id)", w="event_type = 'purchase' AND event_id % 7 <> 0", c="count(*) FILTER (value > 20), count(*) FILTER (value > 5 AND value <= 20), count(*) FILTER (NOT coalesce(value > 5, false)), NULL, NULL")}
              UNION ALL {SIDE.format(e="adverse_event", n="count(*)", w="event_type = 'click'", c="NULL, NULL, NULL, count(*) FILTER (value > 10), count(*) FILTER (NOT coalesce(value > 10, false))")})
        SELECT a.*, CASE WHEN gvkey % 4 <> 0 THEN concat('Firm ', gvkey) END AS company_name_compustat, CASE WHEN gvkey % 4 <> 0 THEN CAST(2800 + gvkey % 1100 AS VARCHAR) END AS sic,
               CASE WHEN gvkey % 4 <> 0 THEN 'A' END AS costat, CASE WHEN gvkey % 4 <> 0 THEN gvkey + 5 END AS cik
        FROM a WHERE EXISTS (SELECT 1 FROM e WHERE e.gvkey = a.gvkey AND e.year = a.year AND e.event_type IN ('signup', 'view'))
    """,
    "filing_classes": f"""
        WITH {FILED} SELECT doc_id, md5(lead) AS lead_md5, n_flags, n_flags + flag_untitled_letter AS n_flags_incl_untitled, has_fda_context, product_domain,
        product_domain = 'device' AS is_device_domain, CASE WHEN len(found) > 0 THEN 'item_anchored' ELSE 'exhibit_top' END AS lead_source, CAST(length(text) AS INT) AS doc_chars,
        {", ".join(f"flag_{e}, body_mentions_{e}" for e in texts.EVENT_PHRASES)}, {", ".join(f"domain_{d}_hits, domain_{d}_lead_hits" for d in texts.DOMAIN_TERMS)} FROM r
    """,
    "device_filings": f"""
        WITH {FILED}, b AS (SELECT doc_id, n_flags, product_domain, CASE sic WHEN '3841' THEN 'device' WHEN '2834' THEN 'pharma_bio' ELSE 'other' END AS sic_bucket FROM r),
        d AS (SELECT *, CASE WHEN product_domain = 'device' THEN 'text' WHEN product_domain IN ('unspecified', 'mixed') AND sic_bucket = 'device' THEN 'sic_fallback' END AS device_evidence FROM b)
        SELECT doc_id, sic_bucket, device_evidence FROM d WHERE n_flags > 0 AND device_evidence IS NOT NULL
    """,
    "listing_verdicts": """
        WITH o AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS t, CASE o_orderkey % 8 WHEN 0 THEN 'L' WHEN 1 THEN 'D' WHEN 2 THEN 'G' WHEN 3 THEN 'O' WHEN 4 THEN 'S' ELSE 'P' END AS k, DATE '1996-06-15' AS d FROM orders),
        s AS (SELECT c, any_value(d) AS d, min(t) AS first, max(t) FILTER (k = 'P' AND t <= d) AS last, min(t) FILTER (k = 'P') AS first_report,
                     max(t) FILTER (k IN ('L', 'S') AND t <= d) AS reg, max(t) FILTER (k = 'L' AND t <= d) AS latest, count(*) FILTER (k = 'L') AS n_reg FROM o GROUP BY c),
        g AS (SELECT s.*, coalesce(d - reg <= 450, false) AS new,
                     (SELECT min(t) FROM o WHERE o.c = s.c AND k = 'G' AND t <= s.d AND (s.last IS NULL OR s.last - t <= 30)) AS gone,
                     EXISTS (SELECT 1 FROM o x WHERE x.c = s.c AND x.k = 'D' AND x.t <= s.d AND EXISTS (SELECT 1 FROM o y WHERE y.c = s.c AND y.k = 'L' AND y.t > s.d AND y.t - x.t >= 180)) AS apart,
                     EXISTS (SELECT 1 FROM o x WHERE x.c = s.c AND x.k = 'D' AND x.t > s.latest AND x.t <= s.d AND EXISTS (SELECT 1 FROM o y WHERE y.c = s.c AND y.k = 'P' AND y.t - x.t > 365)) AS moved,
                     EXISTS (SELECT 1 FROM o x WHERE x.c = s.c AND x.k = 'D' AND x.t > s.d AND NOT EXISTS (SELECT 1 FROM o y WHERE y.c = s.c AND y.k = 'L' AND y.t > s.d AND y.t < x.t)) AS later
              FROM s),
        r AS (SELECT *, CASE WHEN c % 2 = 0 THEN NOT (n_reg <= 3 AND apart) WHEN latest IS NOT NULL THEN NOT moved ELSE later END AS listed,
                     CASE WHEN last IS NOT NULL THEN 'last periodic report ' || last ELSE 'IPO registration within the prior 15 months' END AS seen,
                     CASE WHEN first_report IS NULL THEN 1 WHEN last IS NULL AND NOT new THEN 2 WHEN gone IS NOT NULL THEN 3 WHEN d - last > 460 AND NOT new THEN 4
                          WHEN c % 7 = 0 THEN 5 WHEN c % 5 <> 0 THEN 6 ELSE 7 END AS rule FROM g)
        SELECT c AS o_custkey, CASE WHEN rule <= 4 THEN 'NO' WHEN rule = 6 AND listed THEN 'YES' ELSE 'OTC' END AS status,
               CASE rule WHEN 1 THEN 'SEC filer but never filed 10-K/10-Q/20-F (e.g., Form D only) - not public' WHEN 2 THEN 'not yet public: first periodic report ' || first_report
                    WHEN 3 THEN 'no longer public: deregistered (Form 15) ' || gone WHEN 4 THEN 'no longer public: last periodic report ' || last
                    WHEN 5 THEN 'SEC-reporting at letter date (' || seen || '), but the stock was not exchange-listed then (OTC)'
                    WHEN 6 THEN 'SEC-reporting (' || seen || CASE WHEN listed THEN '); exchange-listed per EDGAR registration/delisting record' ELSE '), but no evidence of an exchange listing' END
                    ELSE 'SEC-reporting at letter date (' || seen || '), but the stock traded OTC, not on a US exchange' END AS evidence,
               CASE WHEN rule = 6 AND listed THEN CASE WHEN c % 2 = 0 THEN 'Nasdaq' ELSE 'US exchange (not identified)' END END AS exchange
        FROM r
    """,
    "name_keys": """
        SELECT c_custkey, c_name || ' x' AS collapsed, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'a' END, 'b', CASE WHEN c_custkey % 3 = 0 THEN 'c' END) AS joined,
               CASE WHEN c_custkey % 2 = 0 THEN 'a' END AS first_listed, CASE WHEN c_custkey % 5 <> 0 THEN 3 ELSE 0 END AS n_listed, c_name AS unarchived,
               CAST(length(trim(regexp_replace(replace(c_name, '#', ' AND '), '[^A-Za-z0-9]+', ' ', 'g')) || ' DE') AS INT) AS n_normalized
        FROM customer
    """,
    "date_parts": """
        WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
        p AS (SELECT *, CASE WHEN o_orderkey % 3 <> 2 THEN day END AS parsed, year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END AS fy FROM o)
        SELECT o_orderkey, parsed, round(fy + (day - make_date(CAST(fy - 1 AS INT), 10, 1)) / 365.25, 6) AS fiscal_position, CAST(abs(day - DATE '1995-01-01') AS INT) AS gap,
               parsed IS NULL OR year(parsed) BETWEEN 1993 AND 1995 AS in_window_or_unknown, last_day(CAST(last_day(day) - INTERVAL 3 MONTH AS DATE)) AS three_back
        FROM p
    """,
    "title_lines": """
        SELECT o_orderkey, 'Clerk ' || o_custkey || ' Ltd' AS company, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 144 MONTH AS DATE) END AS dated,
               'Clerk ' || o_custkey || ' Ltd' AS recipient FROM orders
    """,
}

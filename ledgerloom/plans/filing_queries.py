"""Queries of filings: sections and their scores, and filings combined with events of their periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import texts
from ledgerloom.operators import checks, temporal

from . import composites
from .tables import table

D = lambda c: F.col(c).cast("date")

#: The day from which the letters of these tables count as complete.
LETTERS_SINCE = "1996-07-01"

#: Sentences on events, which a document gets by its number, and the headings around them.
TOLD = (
    (2, "We received a warning letter from the agency in March 2019. "),
    (3, "Any product recall could harm our results. "),
    (5, "The company announced a recall of certain pumps during the quarter. "),
    (7, "An adverse event may lead to a warning letter. "),
    (11, "We submitted a response to each medical device report and MDR. "),
)
CONTENTS = "Item 1A. Risks 3 Item 1B. Staff 4 Item 2. Sites 5 Item 3. Law 6 Item 7. Review 7 Item 8. Books 9 "
HEADINGS = ("Item 1A. ", " Item 2. ", " Item 3. Item 7. ", " Item 8. ")


def _filed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings, the even ones annual: contents, then the text and its sentences in each section."""
    told = F.concat(*[F.when(F.col("doc_id") % k == 0, F.lit(s)).otherwise("") for k, s in TOLD])
    risks, sites, review, end = (F.lit(h) for h in HEADINGS)
    body = F.concat("text", F.lit(" "), told)
    whole = F.concat(F.lit(CONTENTS), risks, body, sites, told, body, review, body, told, end)
    form = F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q")
    return table(spark, sf, "documents").select("doc_id", form.alias("form"), whole.alias("text"))


def filing_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both sections of every filing, and the mentions of events in them."""
    return composites.score_filings(_filed(spark, sf))


def _counted(rows: DataFrame, extra: dict) -> DataFrame:
    return rows.groupBy("gvkey", "event_date").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in extra.items()])


def _combined(spark: SparkSession, sf: str, book: checks.Reconciliation | None = None) -> DataFrame:
    """A filing for each customer and quarter with orders; shipments are events, orders current reports."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("gvkey"), "o_orderkey", D("o_orderdate").alias("day"), "o_orderpriority")
    quarter = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    filed = o.groupBy("gvkey", quarter.alias("report_date")).agg(F.min("o_orderkey").alias("accession"))
    filed = filed.withColumns({"form": F.when(F.month("report_date") == 12, "10-K").otherwise("10-Q"), "filing_date": F.date_add("report_date", 40)})
    scores = filing_scores(spark, sf).select("doc_id", *[f"mda_{e}_substantive" for e in composites.EVENT_TYPES])
    text = filed.withColumn("doc_id", F.col("gvkey") * 2 + F.when(F.col("form") == "10-Q", 1).otherwise(0))
    scored = text.join(scores, "doc_id", "left").drop("doc_id").na.fill(0)
    filings = temporal.reporting_periods(scored)
    shipped = F.when(F.col("l_linenumber") != 7, D("l_shipdate"))  # the day of the seventh line is unknown
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity", shipped.alias("event_date"))
    e = l.join(o.select("o_orderkey", "gvkey"), "o_orderkey")
    q = F.col("l_quantity")
    events = {
        "warning_letter": _counted(e.filter("l_returnflag = 'R'"), {}),
        "recall": _counted(e.filter("l_returnflag = 'A'"), {"class_i": q > 40, "class_ii": (q > 20) & (q <= 40), "class_iii": q <= 20}),
        "adverse_event": _counted(e.filter("l_returnflag = 'N'"), {"tier_a": q > 25, "tier_b": q <= 25}),
    }
    priority = {"warning_letter": "1", "recall": "2", "adverse_event": "3"}
    flags = [F.startswith("o_orderpriority", F.lit(p)).cast("int").alias(f"flag_{e}") for e, p in priority.items()]
    reports = o.filter("substr(o_orderpriority, 1, 1) < '4'").select("gvkey", F.date_add("day", 45).alias("file_date"), *flags)
    active = o.filter("o_orderkey % 3 = 0").select("gvkey", F.year("day").alias("year"))
    return composites.combine(filings, events, reports, active, book, LETTERS_SINCE)


def combined_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with the events and current reports of their periods, and of their fiscal years."""
    return _combined(spark, sf).drop("period_end_imputed")


def combined_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How often filings of periods with and without an event disclose it."""
    return composites.combined_shares(_combined(spark, sf))


QUERIES = {f.__name__: f for f in (filing_scores, combined_filings, combined_shares)}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


SAID = " || ".join(f"CASE WHEN doc_id % {k} = 0 THEN '{_quoted(s)}' ELSE '' END" for k, s in TOLD)


def _offsets(name: str, source: str, text: str, pattern: str) -> str:
    """Offsets of a pattern's matches: the texts between them and the matches, summed up."""
    return f"""
    {name}p AS (SELECT doc_id, unnest(regexp_split_to_array({text}, '{pattern}')) AS gap, unnest(list_append(regexp_extract_all({text}, '{pattern}'), NULL)) AS hit,
                generate_subscripts(regexp_split_to_array({text}, '{pattern}'), 1) AS i FROM {source}),
    {name} AS (SELECT doc_id, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS pos FROM {name}p QUALIFY hit IS NOT NULL)
    """


def _section(name: str, form: str, section: str) -> str:
    """The widest stretch from a heading to the next end; RE2 has no lookahead, so its one case is a condition on the next character."""
    rule = texts.SECTIONS[form, section]
    start, _, unless = rule.start.partition("(?!a)")
    ahead = f"AND lower(substr(text, CAST(h.pos + length(h.hit) + 1 AS BIGINT), 1)) <> 'a'" if "(?!a)" in rule.start else ""
    return f"""
    {name}f AS (SELECT * FROM f WHERE form = '{form}'), {_offsets(name + "s", name + "f", "text", "(?i)" + start + unless)}, {_offsets(name + "e", name + "f", "text", "(?i)" + "|".join(rule.ends))},
    {name}h AS (SELECT h.doc_id, h.pos, text FROM {name}s h JOIN f USING (doc_id) WHERE true {ahead}),
    {name}j AS (SELECT a.doc_id, a.pos AS low, b.pos AS high, text FROM {name}h a ASOF JOIN {name}e b ON a.doc_id = b.doc_id AND a.pos < b.pos),
    {name} AS (SELECT doc_id, substr(text, CAST(low + 1 AS BIGINT), CAST(high - low AS BIGINT)) AS x FROM {name}j WHERE true
               QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY high - low DESC, low) = 1)
    """


PARTS = {"rf": "risk_factors", "mda": "mda"}


def _mentions(part: str, event: str) -> str:
    n, around, before = f"{part}_{event}", texts.AROUND_CHARS, texts.BEFORE_CHARS
    return f"""
    {_offsets(n + "_o", "x" + part, "x", "(?i)" + texts.FILING_TERMS[event])},
    {n}_w AS (SELECT doc_id, regexp_matches(substr(x, CAST(greatest(pos - {before}, 0) + 1 AS BIGINT), CAST(least(pos, {before}) AS BIGINT)), '{texts.LOCAL_HEDGES}') AS hedged,
              regexp_matches(substr(x, CAST(greatest(pos - {around}, 0) + 1 AS BIGINT), CAST(least(pos, {around}) + length(hit) + {around} AS BIGINT)), '{texts.ACTUAL_MARKERS}') AS actual
              FROM {n}_o JOIN x{part} USING (doc_id)),
    {n}_n AS (SELECT doc_id, CAST(count(*) AS INT) AS {n}_mentions, CAST(count(*) FILTER (actual AND NOT hedged) AS INT) AS {n}_substantive,
              CAST(count(*) FILTER (hedged) AS INT) AS {n}_hedged FROM {n}_w GROUP BY doc_id)
    """


ALL = [(p, e) for p in PARTS for e in composites.EVENT_TYPES]
SCORES = f"""
    f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form,
          '{CONTENTS}{HEADINGS[0]}' || text || ' ' || {SAID} || '{HEADINGS[1]}' || {SAID} || text || ' ' || {SAID} || '{HEADINGS[2]}' || text || ' ' || {SAID} || {SAID} || '{HEADINGS[3]}' AS text
          FROM documents),
    {", ".join(_section(f"{p}{form[-1].lower()}", form, s) for p, s in PARTS.items() for form in ("10-K", "10-Q"))},
    {", ".join(f"x{p} AS (SELECT f.doc_id, CASE WHEN length(x) >= {texts.SECTION_CHARS} THEN x ELSE '' END AS x FROM f LEFT JOIN (FROM {p}k UNION ALL FROM {p}q) USING (doc_id))" for p in PARTS)},
    {", ".join(_mentions(p, e) for p, e in ALL)},
    scores AS (SELECT f.doc_id, form, length(xrf.x) > 0 AS has_risk_factors, length(xmda.x) > 0 AS has_mda, CAST(length(xrf.x) AS INT) AS rf_chars, CAST(length(xmda.x) AS INT) AS mda_chars,
          {", ".join(f"coalesce({p}_{e}_{w}, 0) AS {p}_{e}_{w}" for p, e in ALL for w in ("mentions", "substantive", "hedged"))},
          {", ".join(f"coalesce(rf_{e}_{w}, 0) + coalesce(mda_{e}_{w}, 0) AS {e}_{w}_total" for e in composites.EVENT_TYPES for w in ("mentions", "substantive"))}
          FROM f JOIN xrf USING (doc_id) JOIN xmda USING (doc_id) {" ".join(f"LEFT JOIN {p}_{e}_n USING (doc_id)" for p, e in ALL)})
"""

EVENTS = {
    "warning_letter": ("R", {}),
    "recall": ("A", {"n_recall_class_i": "l_quantity > 40", "n_recall_class_ii": "l_quantity > 20 AND l_quantity <= 40", "n_recall_class_iii": "l_quantity <= 20"}),
    "adverse_event": ("N", {"n_mdr_tier_a": "l_quantity > 25", "n_mdr_tier_b": "l_quantity <= 25"}),
}
NEW = [n for _, extra in EVENTS.values() for n in extra]


def _events(e: str) -> str:
    flag, extra = EVENTS[e]
    inside = "shipped > {s} AND shipped <= period_end"
    more = "".join(f", count(*) FILTER ({c}) AS {n}" for n, c in extra.items())
    return f"""
    {e}_q AS (SELECT accession, count(*) AS n_{e}{more} FROM p JOIN i ON i.gvkey = p.gvkey AND {inside.format(s="period_start")} WHERE l_returnflag = '{flag}' GROUP BY accession),
    {e}_y AS (SELECT accession, count(*) AS fy_n_{e} FROM y JOIN i ON i.gvkey = y.gvkey AND {inside.format(s="fy_start")} WHERE l_returnflag = '{flag}' GROUP BY accession)
    """


TYPES = composites.EVENT_TYPES
FLAGS = {"warning_letter": "1", "recall": "2", "adverse_event": "3"}
LETTERS = f"DATE '{LETTERS_SINCE}'"
COMBINED = f"""
    {SCORES},
    o AS (SELECT o_custkey AS gvkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, substr(o_orderpriority, 1, 1) AS k FROM orders),
    g AS (SELECT gvkey, CAST(last_day(date_trunc('quarter', day) + INTERVAL 2 MONTH) AS DATE) AS report_date, min(o_orderkey) AS accession FROM o GROUP BY 1, 2),
    b AS (SELECT *, CASE WHEN month(report_date) = 12 THEN '10-K' ELSE '10-Q' END AS form, lag(report_date) OVER (PARTITION BY gvkey ORDER BY report_date) AS prev FROM g),
    p AS (SELECT gvkey, accession, b.form, report_date, report_date + 40 AS filing_date, report_date AS period_end, CAST(year(report_date) AS INT) AS reporting_year, CAST(quarter(report_date) AS INT) AS reporting_quarter,
          CASE WHEN report_date - prev <= 120 THEN prev ELSE CAST(report_date - INTERVAL 3 MONTH AS DATE) END AS period_start,
          {", ".join(f"coalesce(mda_{e}_substantive, 0) AS mda_{e}_substantive" for e in TYPES)}
          FROM b LEFT JOIN scores ON doc_id = gvkey * 2 + CASE WHEN b.form = '10-Q' THEN 1 ELSE 0 END),
    z AS (SELECT gvkey, accession, period_end, lag(period_end) OVER (PARTITION BY gvkey ORDER BY period_end) AS prev FROM p WHERE form = '10-K'),
    y AS (SELECT gvkey, accession, period_end, CASE WHEN period_end - prev <= 400 THEN prev ELSE CAST(period_end - INTERVAL 12 MONTH AS DATE) END AS fy_start FROM z),
    i AS (SELECT gvkey, l_returnflag, l_quantity, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS shipped FROM lineitem JOIN o ON l_orderkey = o_orderkey),
    {", ".join(_events(e) for e in TYPES)},
    r AS (SELECT accession, {", ".join(f"count(*) FILTER (k = '{k}') AS n_8k_{e}" for e, k in FLAGS.items())}, count(*) AS n_8k_any_event
          FROM p JOIN o ON o.gvkey = p.gvkey AND day + 45 > period_start AND day + 45 <= period_end WHERE k < '4' GROUP BY accession),
    n AS (SELECT p.*, fy_start, {", ".join(f"coalesce({c}, 0) AS {c}" for c in [*[f"n_{e}" for e in TYPES], *NEW, *[f"n_8k_{e}" for e in TYPES], "n_8k_any_event"])},
          {", ".join(f"CASE WHEN form = '10-K' THEN coalesce(fy_n_{e}, 0) END AS fy_n_{e}" for e in TYPES)},
          EXISTS (SELECT 1 FROM o WHERE o.gvkey = p.gvkey AND year(day) = reporting_year AND o_orderkey % 3 = 0) AS active
          FROM p LEFT JOIN y USING (accession) LEFT JOIN r USING (accession) {" ".join(f"LEFT JOIN {e}_q USING (accession) LEFT JOIN {e}_y USING (accession)" for e in TYPES)}),
    c AS (SELECT * EXCLUDE (active), CAST(active AS INT) AS compustat_active_year, CAST(period_start >= {LETTERS} AS INT) AS warning_letter_data_covered,
          CASE WHEN form = '10-K' THEN CAST(fy_start >= {LETTERS} AS INT) END AS fy_warning_letter_data_covered, CAST(n_8k_any_event > 0 AS INT) AS has_8k_any_event,
          {", ".join(f"CAST(n_{e} > 0 AS INT) AS event_{e}, CAST(n_8k_{e} > 0 AS INT) AS has_8k_{e}, CAST(fy_n_{e} > 0 AS INT) AS fy_event_{e}, CAST(mda_{e}_substantive > 0 AS INT) AS mda_{e}_substantive_flag" for e in TYPES)},
          CAST({" + ".join(f"n_{e}" for e in TYPES)} > 0 AS INT) AS event_any, CAST(n_warning_letter + n_recall > 0 AS INT) AS event_letter_or_recall FROM n)
"""


def _share(n: str, of: str) -> str:
    return f"CASE WHEN {of} > 0 THEN round(100 * {n} / {of}, 1) END"


ORACLE_SQL = {
    "filing_scores": f"WITH {SCORES} SELECT * FROM scores",
    "combined_filings": f"WITH {COMBINED} SELECT * FROM c",
    "combined_shares": f"""
        WITH {COMBINED},
        k AS ({" UNION ALL ".join(f"SELECT reporting_year, '{e}' AS event, event_{e} AS h, mda_{e}_substantive_flag AS t FROM c" + (" WHERE warning_letter_data_covered = 1" if e == "warning_letter" else "") for e in TYPES)}),
        s AS (SELECT reporting_year, event, count(*) AS n_filings, count(*) FILTER (h = 1) AS n_with_event, count(*) FILTER (h = 1 AND t = 1) AS n_told_with_event,
              count(*) FILTER (h = 0 AND t = 1) AS n_told_without_event FROM k GROUP BY ALL)
        SELECT *, {_share("n_told_with_event", "n_with_event")} AS pct_told_with_event, {_share("n_told_without_event", "(n_filings - n_with_event)")} AS pct_told_without_event FROM s
    """,
}

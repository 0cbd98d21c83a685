"""Queries of the text operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import texts
from ledgerloom.functions.dates import nearest_gap, text_dates

from .tables import table

#: Vocabularies of the synthetic corpus (the regulatory ones occur in tests).
EVENTS = {"license": r"(?i)licensed|license", "rights": r"(?i)rights reserved", "secret": r"(?i)token = "}
CONTEXT = r"(?i)version|reserved|token"
DOMAINS = {"english": r" (?:the|of|and) ", "french": r" (?:le|la|des) ", "german": r" (?:der|die|und) "}


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("text"))


def page_content(spark: SparkSession, sf: str) -> DataFrame:
    """Readable text of the main element of each page."""
    return table(spark, sf, "pages").select("page_id", texts.page_text(F.col("html")).alias("text"))


def lead_classify(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in texts.event_flags(t, texts.lead(t), EVENTS, CONTEXT).items()])


def item_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Leads of documents; every 'License, Version n.n' is written as an item heading first."""
    t = F.regexp_replace("text", r"License, Version (\d)", r"Item $1")
    t = F.regexp_replace(t, r"Item (\d+)\.0", r"Item $1.01")
    return table(spark, sf, "documents").select("doc_id", texts.lead_source(t).alias("lead_source"), F.md5(texts.lead(t)).alias("lead_md5"))


def domain_score(spark: SparkSession, sf: str) -> DataFrame:
    hits = texts.domain_hits(F.col("text"), DOMAINS)
    return table(spark, sf, "documents").select("doc_id", *[c.cast("long").alias(f"n_{n}") for n, c in hits.items()], texts.domain_label(hits).alias("domain"))


def two_signal_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Inclusion by text, or by source where the text does not tell."""
    hits = texts.domain_hits(F.col("text"), DOMAINS)
    label = texts.domain_label(hits)
    core = F.col("source").isin("src1", "src2", "src3")
    evidence = F.when(label == "english", "text").when(label.isin("unspecified", "mixed") & core, "source_fallback")
    return table(spark, sf, "documents").select("doc_id", label.alias("domain"), evidence.alias("evidence")).filter("evidence IS NOT NULL")


def mention_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of a word, hedged by another just before, actual by a third near by."""
    s = texts.mention_scores(F.col("text"), r"\bthe\b", hedges=r"\b(?:of|and)\b", markers=r"\bto\b", before=20, around=60)
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*")


def widest_span(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", texts.widest_span(F.col("text"), r"\bthe\b", (r"\.\s", r"\n")).alias("span"))


def letter_types(spark: SparkSession, sf: str) -> DataFrame:
    """Letters made of documents: type, printed dates and id."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))
    head = F.when(F.col("lang") == "en", "WARNING LETTER\n").when(F.col("lang") == "fr", "The agency has completed an evaluation of your firm's corrective actions\n").when(F.col("lang") == "de", "Response Letter\n").otherwise("")
    body = F.concat(head, F.lit("Dated "), F.date_format(day, "MMMM d, yyyy"), F.lit("\nRef "), F.col("doc_id"), F.lit("\n"), F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return d.select(
        "doc_id",
        texts.letter_type(F.col("body")).alias("doc_type"),
        nearest_gap(text_dates(F.substring("body", 1, 3000)), F.lit("2020-06-01").cast("date")).alias("gap_days"),
        texts.printed_id(F.col("body"), F.col("doc_id")).alias("id_printed"),
    )


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.countDistinct("p.k").alias("n_distinct"))


QUERIES = {
    f.__name__: f
    for f in (html_to_text, page_content, lead_classify, item_leads, domain_score, two_signal_rule, mention_scoring, widest_span, letter_types, json_props)
}

HITS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{n}" for n, p in DOMAINS.items())
LABEL = """
    CASE WHEN m = 0 THEN 'unspecified'
         WHEN n_english = m AND NOT (n_french > 0 AND m - n_french <= 1) AND NOT (n_german > 0 AND m - n_german <= 1) THEN 'english'
         WHEN n_french = m AND NOT (n_english > 0 AND m - n_english <= 1) AND NOT (n_german > 0 AND m - n_german <= 1) THEN 'french'
         WHEN n_german = m AND NOT (n_english > 0 AND m - n_english <= 1) AND NOT (n_french > 0 AND m - n_french <= 1) THEN 'german' ELSE 'mixed' END
"""
SCORED = f"s AS (SELECT doc_id, source, {HITS} FROM documents), d AS (SELECT *, {LABEL} AS domain FROM (SELECT *, greatest(n_english, n_french, n_german) AS m FROM s))"
FLAG = ", ".join(
    f"CAST(regexp_matches(lead, '{p}') AND regexp_matches(text, '{CONTEXT}') AS INT) AS flag_{n}, CAST(regexp_matches(text, '{p}') AS INT) AS body_mentions_{n}"
    for n, p in EVENTS.items()
)
SUM = " + ".join(f"flag_{n}" for n in EVENTS)

LEADS = """
    p AS (SELECT doc_id, text, regexp_split_to_array(text, '(?i)item\\s+[0-9]+\\.[0-9]+') AS gaps, regexp_extract_all(text, '(?i)item\\s+[0-9]+\\.[0-9]+') AS hits FROM {t}),
    s AS (SELECT doc_id, text, hits, [list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) for i in range(1, len(hits) + 1)] AS starts FROM p),
    l AS (SELECT doc_id, text, hits, CASE WHEN len(hits) > 0 THEN array_to_string([substr(text, CAST(x AS BIGINT) + 1, 500) for x in starts], ' ') ELSE substr(text, 1, 1000) END AS lead FROM s)
"""
#: Offsets of a pattern's matches: the texts between them and the matches, summed up.
OFFSETS = """
    {n}p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{p}')) AS gap, unnest(list_append(regexp_extract_all(text, '{p}'), NULL)) AS hit, generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM documents),
    {n} AS (SELECT doc_id, i, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS pos FROM {n}p QUALIFY hit IS NOT NULL)
"""

ORACLE_SQL = {
    "html_to_text": r"""
        WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
              '&#39;', ''''), '&amp;', '&') AS t FROM a)
        SELECT page_id, trim(regexp_replace(t, '[\s\x{A0}]+', ' ', 'g')) AS text FROM b
    """,
    "lead_classify": f"""
        WITH {LEADS.format(t="documents")}, f AS (SELECT doc_id, regexp_matches(text, '{CONTEXT}') AS has_fda_context, {FLAG} FROM l)
        SELECT *, {SUM} AS n_flags, {SUM} AS n_flags_incl_untitled FROM f
    """,
    "item_leads": f"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, 'License, Version ([0-9])', 'Item \\1', 'g'), 'Item ([0-9]+)\\.0', 'Item \\1.01', 'g') AS text FROM documents),
        {LEADS.format(t="t")}
        SELECT doc_id, CASE WHEN len(hits) > 0 THEN 'item_anchored' ELSE 'exhibit_top' END AS lead_source, md5(lead) AS lead_md5 FROM l
    """,
    "domain_score": f"WITH {SCORED} SELECT doc_id, n_english, n_french, n_german, domain FROM d",
    "two_signal_rule": f"""
        WITH {SCORED}, e AS (SELECT doc_id, domain, CASE WHEN domain = 'english' THEN 'text'
             WHEN domain IN ('unspecified', 'mixed') AND source IN ('src1', 'src2', 'src3') THEN 'source_fallback' END AS evidence FROM d)
        SELECT * FROM e WHERE evidence IS NOT NULL
    """,
    "json_props": """
        SELECT event_type, count(CAST(json_extract(props, '$.k') AS INT)) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total,
               count(DISTINCT CAST(json_extract(props, '$.k') AS INT)) AS n_distinct FROM events GROUP BY event_type
    """,
    "mention_scoring": f"""
        WITH {OFFSETS.format(n="m", p=r"(?i)\bthe\b")},
        w AS (SELECT doc_id, regexp_matches(substr(text, CAST(greatest(pos - 20, 0) + 1 AS BIGINT), CAST(least(pos, 20) AS BIGINT)), '\\b(?:of|and)\\b') AS hedged,
                     regexp_matches(substr(text, CAST(greatest(pos - 60, 0) + 1 AS BIGINT), CAST(least(pos, 60) + length(hit) + 60 AS BIGINT)), '\\bto\\b') AS actual
              FROM m JOIN documents USING (doc_id)),
        n AS (SELECT doc_id, count(*) AS mentions, count(*) FILTER (actual AND NOT hedged) AS substantive, count(*) FILTER (hedged) AS hedged FROM w GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(mentions, 0) AS INT) AS mentions, CAST(coalesce(substantive, 0) AS INT) AS substantive, CAST(coalesce(hedged, 0) AS INT) AS hedged
        FROM documents LEFT JOIN n USING (doc_id)
    """,
    "widest_span": f"""
        WITH {OFFSETS.format(n="a", p=r"(?i)\bthe\b")}, {OFFSETS.format(n="b", p=r"\.\s|\n")},
        j AS (SELECT a.doc_id, a.pos AS low, b.pos AS high FROM a ASOF JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos),
        k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY high - low DESC, low) = 1)
        SELECT doc_id, CASE WHEN low IS NULL THEN '' ELSE substr(text, CAST(low + 1 AS BIGINT), CAST(high - low AS BIGINT)) END AS span FROM documents LEFT JOIN k USING (doc_id)
    """,
    "letter_types": r"""
        WITH b AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'WARNING LETTER' || chr(10)
                          WHEN 'fr' THEN 'The agency has completed an evaluation of your firm''s corrective actions' || chr(10) WHEN 'de' THEN 'Response Letter' || chr(10) ELSE '' END
                          || 'Dated ' || strftime(DATE '2020-01-01' + CAST(doc_id % 700 AS INT), '%B %-d, %Y') || chr(10) || 'Ref ' || doc_id || chr(10) || text AS body FROM documents),
        f AS (SELECT doc_id, body, upper(trim(split_part(body, chr(10), 1))) AS first FROM b),
        l AS (SELECT *, CASE WHEN first IN ('WARNING LETTER', 'CLOSEOUT LETTER', 'CLOSE-OUT LETTER', 'RESPONSE LETTER') THEN first ELSE '' END AS label FROM f),
        t AS (SELECT *, substr(CASE WHEN label <> '' THEN regexp_replace(body, '\A[^\n]*\n?', '') ELSE body END, 1, 5000) AS top, substr(body, 1, 3000) AS head FROM l),
        d AS (SELECT doc_id, list_min([abs(x - DATE '2020-06-01') for x in list_filter(list_concat(
                     [CAST(try_strptime(regexp_replace(y, '[,\s]+', ' ', 'g'), '%B %d %Y') AS DATE) for y in
                      regexp_extract_all(head, '(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b')],
                     [CAST(try_strptime(y, '%m/%d/%Y') AS DATE) for y in regexp_extract_all(head, '\b(\d{1,2}/\d{1,2}/\d{4})\b', 1)]), lambda x: x IS NOT NULL)]) AS gap FROM t)
        SELECT doc_id, CASE WHEN regexp_matches(top, '(?i)has completed (?:an )?evaluation of (?:your|the)\s+(?:\S+\s+)?corrective action') THEN 'close-out letter'
                            WHEN label = 'RESPONSE LETTER' THEN 'response letter'
                            WHEN regexp_matches(top, '(?im)^\s*WARNING LETTER\b') OR label = 'WARNING LETTER' THEN 'warning letter' ELSE 'unknown' END AS doc_type,
               CAST(gap AS INT) AS gap_days, regexp_matches(body, '(^|[^0-9])' || doc_id || '([^0-9]|$)') AS id_printed
        FROM t JOIN d USING (doc_id)
    """.replace("\\\\", "\\"),
}

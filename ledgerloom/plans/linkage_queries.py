"""Queries of the linkage operators and name functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import DOMESTIC_FORMS, FOREIGN_FORMS, NOISE_WORDS, entity_family, normalize_fei, normalize_name, padded_key, slug
from ledgerloom.operators import linkage

from .tables import table


def _firms(spark: SparkSession, sf: str) -> DataFrame:
    """Names with corporate forms: brand or type words joined to part names."""
    form = F.element_at(F.lit(["Inc.", "GmbH", "& Co.", "Holdings Ltd", "group, LLC", "S/A"]), F.col("p_size") % 6 + 1)
    return table(spark, sf, "part").select("p_partkey", "p_type", "p_size", F.concat_ws(" ", "p_name", F.lower("p_type"), form).alias("firm"))


FIRMS = """
    firms AS (SELECT p_partkey, p_type, p_size, concat_ws(' ', p_name, lower(p_type),
              ['Inc.', 'GmbH', '& Co.', 'Holdings Ltd', 'group, LLC', 'S/A'][p_size % 6 + 1]) AS firm FROM part)
"""
WORDS = "|".join(sorted(DOMESTIC_FORMS + FOREIGN_FORMS + NOISE_WORDS, key=lambda w: (-len(w), w)))
#: The key by RE2, which has no look-around: tokens are filtered instead.
KEY = (
    "array_to_string(list_filter(string_split(regexp_replace(replace(upper(replace({0}, 'ß', 'ss')), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), ' '), "
    "lambda w: w <> '' AND NOT regexp_full_match(w, '" + WORDS + "')), ' ')"
)
TOKENS = "string_split(regexp_replace(upper({0}), '[^A-Z ]', ' ', 'g'), ' ')"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
FAMILY = (
    f"CASE WHEN list_has_any({TOKENS}, {LIST(FOREIGN_FORMS)}) THEN 'foreign' WHEN list_has_any({TOKENS}, {LIST(DOMESTIC_FORMS)}) THEN 'domestic' ELSE 'none' END"
)


def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return _firms(spark, sf).select("p_partkey", normalize_name(F.col("firm")).alias("name_key"))


def normalize_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The key of whole documents: accents, symbols and all."""
    return table(spark, sf, "documents").select("doc_id", F.md5(normalize_name(F.col("text"))).alias("key_md5"))


def entity_families(spark: SparkSession, sf: str) -> DataFrame:
    return _firms(spark, sf).select("p_partkey", entity_family(F.col("firm")).alias("family"))


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("00"), F.col("s_suppkey").cast("string"), F.lit("-7.0"))
    return table(spark, sf, "supplier").select("s_suppkey", normalize_fei(raw).alias("fei"), padded_key(F.col("s_suppkey")).alias("gvkey"), slug(F.col("s_name"), 12).alias("slug"))


def unique_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    candidates = linkage.name_candidates(_firms(spark, sf).withColumnRenamed("p_partkey", "gvkey"), "gvkey", ["firm"])
    return linkage.unique_lookup(candidates, "name_key", "gvkey")


def match_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of large parts against the keys of the others, with the review flag."""
    firms = _firms(spark, sf).withColumn("name_key", normalize_name(F.col("firm")))
    master = firms.filter("p_size <= 25").select("name_key", F.col("p_partkey").alias("gvkey"), F.col("firm").alias("master_firm"))
    lookup = linkage.unique_lookup(master, "name_key", "gvkey").join(master.groupBy("name_key").agg(F.min("master_firm").alias("master_firm")), "name_key")
    out = linkage.match_names(firms.filter("p_size > 25"), lookup, "name_key", "gvkey", "firm", "master_firm")
    return out.select("p_partkey", "name_key", "gvkey", "match_status", "n_candidates", "review_suggested")


def gated_match(spark: SparkSession, sf: str) -> DataFrame:
    firms = _firms(spark, sf).withColumn("name_key", F.regexp_replace(normalize_name(F.col("firm")), " .*", ""))
    master = table(spark, sf, "part").select(F.upper(F.split("p_name", " ")[0]).alias("name_key"), F.col("p_brand").alias("gvkey")).filter("length(name_key) <> 3")
    lookup = linkage.unique_lookup(master.groupBy("name_key").agg(F.min("gvkey").alias("gvkey")), "name_key", "gvkey")
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("gvkey")).distinct()
    sic = brands.withColumn("sic", (F.lit(3830) + F.regexp_extract("gvkey", r"(\d+)", 1).cast("int")).cast("string"))
    return linkage.match_with_gate(firms, lookup, "name_key", "gvkey", sic).select("p_partkey", "name_key", "gvkey", "match_status")


def trust_precedence(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    pick = lambda df, k: df.select(F.col("p_name").alias("name_key"), F.col("p_partkey").alias("gvkey")).withColumn("k", F.lit(k))
    sources = {"override": pick(p.filter("p_size < 3"), 1), "resolved": pick(p.filter("p_type = 'PROMO'"), 2), "fuzzy": pick(p, 3)}
    return linkage.most_trusted(sources, ["name_key"], ["gvkey"]).select("name_key", "gvkey", "match_source")


def prefix_longest(spark: SparkSession, sf: str) -> DataFrame:
    """Names extended by type and brand, matched to the longest indexed prefix."""
    p = table(spark, sf, "part")
    names = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    short = p.select(F.col("p_name").alias("name"), F.lit(1).alias("parent")).distinct()
    longer = p.filter("p_size <= 10").select(F.concat_ws(" ", "p_name", "p_type").alias("name"), F.lit(2).alias("parent")).distinct()
    out = linkage.longest_prefix(names, short.unionByName(longer), "name", "parent", least_chars=8, least_tokens=2)
    return out.select("p_partkey", "matched_prefix", "parent")


def tiered_link(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    index = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("gvkey"))
    out = linkage.resolve_tiers(rows, index, index, "name", "gvkey")
    return out.select("p_partkey", "gvkey", "link_tier")


def device_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    """First word of a text that is one of the words the license lines use."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "[ \n]+").alias("words"))
    index = spark.sql("SELECT * FROM VALUES ('Apache', 1), ('License,', 2), ('rights', 3), ('MIT', 4), ('token', 5) AS t(name, key)")
    out = linkage.first_hit(d, "words", index, "name", "key", "doc_id")
    return out.select("doc_id", "hit_pos", "name", "key")


def curated_map(spark: SparkSession, sf: str) -> DataFrame:
    """Curated links from four sources made of parts: project rows, windows and conflicts decide."""
    p = table(spark, sf, "part").withColumn("name_key", F.upper("p_name"))
    link = lambda df, low, high: df.select("name_key", F.col("p_partkey").alias("gvkey"), F.lit(low).alias("valid_from"), F.lit(high).alias("valid_to"))
    sources = {
        "project_override_windowed": link(p.filter("p_size = 1 AND p_type = 'PROMO'"), 1990, 1999),
        "ct_override_windowed": link(p.filter("p_size = 2 AND p_type = 'SMALL'"), 1995, 2005).unionByName(link(p.filter("p_size = 3 AND p_type = 'LARGE'"), 2000, 2010)),
        "ct_override": link(p.filter("p_size = 4"), 1900, 2099),
        "ct_resolved": link(p, 1900, 2099),
    }
    return linkage.curated_map(sources).select("name_key", "gvkey", "valid_from", "valid_to", "match_source")


def fuzzy_top1(spark: SparkSession, sf: str) -> DataFrame:
    """Firm names against names with a letter dropped: best match at 90 or more."""
    firms = _firms(spark, sf).select(normalize_name(F.col("firm")).alias("name")).distinct()
    other = firms.select(F.concat(F.substring("name", 1, 5), F.substring("name", 7, 99)).alias("other")).distinct()
    return linkage.fuzzy_top1(firms, other, "name", "other").select("name", "other", F.round("similarity", 3).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_names, normalize_texts, entity_families, identifiers, unique_name_lookup, match_names, gated_match, trust_precedence, prefix_longest,
        tiered_link, device_first_hit, curated_map, fuzzy_top1,
    )
}

ORACLE_SQL = {
    "normalize_names": f"WITH {FIRMS} SELECT p_partkey, {KEY.format('firm')} AS name_key FROM firms",
    "normalize_texts": f"SELECT doc_id, md5({KEY.format('text')}) AS key_md5 FROM documents",
    "entity_families": f"WITH {FIRMS} SELECT p_partkey, {FAMILY.format('firm')} AS family FROM firms",
    "identifiers": """
        SELECT s_suppkey, ltrim(regexp_replace(regexp_replace('00' || s_suppkey || '-7.0', '\\.0$', ''), '[^0-9]', '', 'g'), '0') AS fei,
               lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS gvkey, regexp_replace(substr(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), 1, 12), '-+$', '') AS slug
        FROM supplier
    """,
    "unique_name_lookup": f"""
        WITH {FIRMS}, k AS (SELECT DISTINCT {KEY.format('firm')} AS name_key, p_partkey AS gvkey FROM firms)
        SELECT name_key, count(*) AS n_candidates, CASE WHEN count(*) = 1 THEN min(gvkey) END AS gvkey FROM k WHERE name_key <> '' GROUP BY name_key
    """,
    "match_names": f"""
        WITH {FIRMS}, k AS (SELECT *, {KEY.format('firm')} AS name_key FROM firms),
        m AS (SELECT name_key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS g, min(firm) AS master_firm FROM k WHERE p_size <= 25 GROUP BY name_key)
        SELECT k.p_partkey, k.name_key, CASE WHEN n = 1 THEN g END AS gvkey,
               CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status, coalesce(n, 0) AS n_candidates,
               coalesce(n = 1 AND {FAMILY.format('firm')} <> {FAMILY.format('master_firm')} AND {FAMILY.format('firm')} <> 'none'
                        AND {FAMILY.format('master_firm')} <> 'none', false) AS review_suggested
        FROM k LEFT JOIN m USING (name_key) WHERE k.p_size > 25
    """,
    "gated_match": f"""
        WITH {FIRMS}, k AS (SELECT p_partkey, string_split({KEY.format('firm')}, ' ')[1] AS name_key FROM firms),
        m AS (SELECT upper(string_split(p_name, ' ')[1]) AS name_key, min(p_brand) AS gvkey FROM part GROUP BY 1 HAVING length(upper(string_split(p_name, ' ')[1])) <> 3),
        s AS (SELECT *, 3830 + CAST(regexp_extract(gvkey, '[0-9]+') AS INT) AS sic FROM m)
        SELECT k.p_partkey, k.name_key, s.gvkey,
               CASE WHEN length(k.name_key) < 5 THEN 'too_short' WHEN s.gvkey IS NULL THEN 'unmatched'
                    WHEN NOT (sic BETWEEN 2833 AND 2836 OR sic BETWEEN 3841 AND 3845) THEN 'out_of_industry' ELSE 'matched' END AS match_status
        FROM k LEFT JOIN s USING (name_key)
    """,
    "trust_precedence": """
        WITH u AS (SELECT p_name, p_partkey, 'override' AS s, 1 AS k FROM part WHERE p_size < 3 UNION ALL
                   SELECT p_name, p_partkey, 'resolved', 2 FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_name, p_partkey, 'fuzzy', 3 FROM part)
        SELECT p_name AS name_key, p_partkey AS gvkey, s AS match_source FROM u QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY k, p_partkey) = 1
    """,
    "prefix_longest": """
        WITH n AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand) AS name FROM part),
        i AS (SELECT DISTINCT p_name AS prefix, 1 AS parent FROM part UNION SELECT DISTINCT concat_ws(' ', p_name, p_type), 2 FROM part WHERE p_size <= 10),
        h AS (SELECT n.p_partkey, i.prefix, i.parent FROM n JOIN i ON starts_with(n.name, i.prefix || ' ') AND length(i.prefix) >= 8
              QUALIFY row_number() OVER (PARTITION BY n.p_partkey ORDER BY length(i.prefix) DESC) = 1)
        SELECT p_partkey, prefix AS matched_prefix, parent FROM n LEFT JOIN h USING (p_partkey)
    """,
    "tiered_link": """
        WITH r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat_ws(' ', p_name, p_type) END AS name FROM part),
        i AS (SELECT p_name AS name, min(p_partkey) AS gvkey FROM part GROUP BY p_name)
        SELECT r.p_partkey, coalesce(e.gvkey, x.gvkey) AS gvkey, CASE WHEN e.gvkey IS NOT NULL THEN 'A_exact' WHEN x.gvkey IS NOT NULL THEN 'B_prefix' END AS link_tier
        FROM r LEFT JOIN i e ON e.name = r.name
        LEFT JOIN i x ON length(x.name) >= 6 AND starts_with(r.name, x.name || ' ')
    """,
    "device_first_hit": """
        WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS ws FROM documents),
        x AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS name FROM w),
        h AS (SELECT doc_id, min(pos) AS hit_pos, arg_min(x.name, pos) AS name, arg_min(key, pos) AS key
              FROM x JOIN (VALUES ('Apache', 1), ('License,', 2), ('rights', 3), ('MIT', 4), ('token', 5)) t(name, key) ON x.name = t.name GROUP BY doc_id)
        SELECT d.doc_id, CAST(h.hit_pos AS INT) AS hit_pos, h.name, h.key FROM documents d LEFT JOIN h USING (doc_id)
    """,
    "curated_map": """
        WITH u AS (SELECT upper(p_name) AS name_key, p_partkey AS gvkey, 1990 AS valid_from, 1999 AS valid_to, 'project_override_windowed' AS match_source, 0 AS k
                   FROM part WHERE p_size = 1 AND p_type = 'PROMO'
                   UNION ALL SELECT upper(p_name), p_partkey, 1995, 2005, 'ct_override_windowed', 1 FROM part WHERE p_size = 2 AND p_type = 'SMALL'
                   UNION ALL SELECT upper(p_name), p_partkey, 2000, 2010, 'ct_override_windowed', 1 FROM part WHERE p_size = 3 AND p_type = 'LARGE'
                   UNION ALL SELECT upper(p_name), p_partkey, 1900, 2099, 'ct_override', 2 FROM part WHERE p_size = 4
                   UNION ALL SELECT upper(p_name), p_partkey, 1900, 2099, 'ct_resolved', 3 FROM part),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY name_key, valid_from, valid_to ORDER BY k, gvkey) = 1),
        m AS (SELECT *, min(k) OVER (PARTITION BY name_key) AS top FROM b),
        s AS (SELECT * FROM m WHERE CASE WHEN top = 0 THEN k = 0 WHEN top = 1 THEN k = 1 ELSE true END)
        SELECT name_key, gvkey, valid_from, valid_to, match_source FROM s
        WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s c ON a.name_key = c.name_key AND a.gvkey <> c.gvkey AND a.valid_from <= c.valid_to AND c.valid_from <= a.valid_to
                          WHERE a.name_key = s.name_key)
    """,
}

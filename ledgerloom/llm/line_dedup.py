"""Line deduplication over overlapping three-line windows.

Every window of three consecutive lines of a document is hashed (128 bits).
Windows that occur again anywhere are found by one aggregation; all but the
first occurrence (least doc_id, then position) are covered, covered windows of
a document are merged to sets of lines, and those lines are removed.

Defined cases: lines end at line feeds; documents with fewer than three lines
and windows without any word are left alone; a null text stays null; rows that
repeat a doc_id and its text are one document and keep the same lines; a null
doc_id comes before any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keyed_join, stored

WINDOW = 3
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2 of every window that holds a word."""
    base = documents(docs).select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array(_lines(F.col("text")))).alias("ls"))
    base = base.filter(F.size("ls") >= WINDOW)
    places = base.select(
        "doc_id", "th", F.posexplode(F.arrays_zip(*[F.slice("ls", 1 + i, F.size("ls") - (WINDOW - 1)).alias(f"l{i}") for i in range(WINDOW)]))
    )
    parts = [F.col(f"col.l{i}") for i in range(WINDOW)]
    return (
        places.filter(F.concat(*parts).rlike(WORD))
        .select("doc_id", "th", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(WINDOW), *reversed(parts)).alias("h2"))
    )


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, th, lines: the numbers (from 0) of the lines to remove of each document that has any."""
    found = stored(windows(docs), "line-windows")
    place = F.struct("doc_id", "th", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    repeated = stored(repeated, "line-repeats")
    hits = keyed_join(found, repeated, ["h1", "h2"], "n", found.count())
    later = hits.filter(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    marked = later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("at"))
    spread = F.flatten(F.transform("at", lambda p: F.array(*[p + i for i in range(WINDOW)])))
    return marked.select("doc_id", "th", F.array_distinct(spread).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without the lines removed, and ``n_lines`` and ``n_removed`` added under these names."""
    columns = docs.columns
    cover = stored(covered(docs), "line-cover").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("lines").alias("__lines")
    )
    rows = docs.withColumn("__hash", F.xxhash64(docs["text"].cast("string")))
    same = rows["doc_id"].cast("long").eqNullSafe(cover["__id"]) & (rows["__hash"] == cover["__th"])
    # Texts meet their lists by sorting at every size; the lists grow with the input and are not broadcast.
    joined = rows.join(cover.hint("merge"), same, "left").withColumn("__ls", F.explode(F.array(_lines(F.coalesce(rows["text"].cast("string"), F.lit(""))))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ls") - 1), F.coalesce("__lines", F.array().cast("array<int>")))
    text = F.array_join(F.transform(stay, lambda i: F.get("__ls", i)), "\n")
    changed = F.when(F.col("__lines").isNotNull(), text).otherwise(rows["text"].cast("string"))
    kept = [changed.alias("text") if c == "text" else rows[f"`{c}`"] for c in columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(rows["text"].isNull(), 0).otherwise(F.size("__ls")).cast("long").alias("n_lines")
    removed = F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_removed")
    return joined.select(*kept, n_lines, removed)


ORACLE_SQL = """
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    w AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c
          FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3)),
    m AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k
          FROM w WHERE regexp_matches(concat(a, b, c), '[^\\x20\\x09-\\x0D]')),
    x AS (SELECT DISTINCT doc_id, pos + o AS pos FROM m, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
    l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
    k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
          FROM l ANTI JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

"""Queries of reports with nested devices, product codes and the backfill of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import linkage

from . import composites
from .tables import table

#: Sources of links in the order of trust; the first is one of those with windows.
WINDOWED, OTHER = linkage.WINDOWED[0], next(s for s in linkage.CURATED_ORDER if s not in linkage.WINDOWED)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reports and their lines as devices: a third of the makers match exactly, a third by prefix, a third not at all."""
    none = lambda name: F.lit(None).cast("string").alias(name)

    def device(e: Column) -> Column:
        s, kind = e["l_suppkey"], e["l_suppkey"] % 3
        maker = F.when(kind == 0, F.concat(F.lit("Maker "), s, F.lit(", Inc."))).when(kind == 1, F.concat(F.lit("Maker "), s, F.lit(" East LLC"))).otherwise(F.concat(F.lit("Unknown "), s))
        return F.struct(
            maker.alias("manufacturer_d_name"), e["l_linestatus"].alias("brand_name"), none("generic_name"), none("model_number"), e["l_partkey"].cast("string").alias("device_report_product_code"),
            none("implant_flag"), none("device_operator"), F.struct((s % 3 + 1).cast("string").alias("device_class"), none("medical_specialty_description")).alias("openfda"),
        )

    # Lines are gathered as they are and become devices in their report: names need not be shuffled and sorted.
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    problem = lambda e: F.when(e["l_returnflag"] == "R", "broke").when(e["l_returnflag"] == "N", "leaked")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey")
    written = lambda day: F.date_format(day, "yyyyMMdd")
    return o.join(lines, "o_orderkey").select(
        "o_orderkey",
        F.when(k % 4 != 0, written("day")).alias("date_received"),
        F.when(k % 8 != 0, written(F.date_sub("day", 10))).alias("date_of_event"),
        F.transform("x", device).alias("device"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("1").alias("n")))).alias("patient"),
        F.transform("x", problem).alias("product_problems"),
        F.lit(None).cast("array<struct<text:string>>").alias("mdr_text"),
    )


def adverse_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports linked by any of their devices within the maker's window, flat."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    name, key = F.concat(F.lit("MAKER "), F.col("s_suppkey")).alias("name_key"), F.col("s_suppkey").alias("gvkey")
    exact, index = s.filter("s_suppkey % 3 = 0").select(name, key), s.filter("s_suppkey % 3 = 1").select(name, key)
    found = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(" EAST")
    windows = s.filter("s_suppkey % 5 = 0").select(F.concat(name, found).alias("name_key"), key, F.lit(1996).alias("valid_from"), F.lit(1998).alias("valid_to"))
    linked = composites.link_adverse_events(_reports(spark, sf), exact, index, windows, "o_orderkey")
    flat = composites.flatten_adverse_events(linked)
    columns = ("n_devices_listed", "manufacturer_d_name", "brand_name", "device_class", "n_patients_listed", "product_problems")
    return flat.select("o_orderkey", "name_key", "gvkey", "link_tier", "event_date", "year", *columns)


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    code: Column = F.concat(F.lit(" b"), p % 400, F.when(p % 2 == 0, F.lit(" ")).otherwise(""))
    flag = F.when(p % 3 == 0, "Y").when(p % 3 == 1, "N").otherwise("?")
    raw = table(spark, sf, "part").filter("p_partkey % 7 <> 0")
    return raw.select(code.alias("product_code"), F.when(F.col("p_size") % 4 == 0, "x").otherwise((F.col("p_size") % 4).cast("string")).alias("device_class"), flag.alias("implant_flag"), F.when(p % 5 == 0, "  ").otherwise("seen").alias("note"))


def product_codes(spark: SparkSession, sf: str) -> DataFrame:
    """One clean row for each code of the parts."""
    return composites.product_codes(_codes(spark, sf))


def product_code_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many shipped lines have a code that is listed, and one with a class, by return flag."""
    l = table(spark, sf, "lineitem").select("l_returnflag", F.upper(F.concat(F.lit("b"), F.col("l_partkey") % 400)).alias("product_code"))
    # Codes are far fewer than lines: lines are counted by code first, so that a frequent code is one row.
    counted = l.groupBy("l_returnflag", "product_code").agg(F.count(F.lit(1)).alias("n"))
    known = product_codes(spark, sf).select("product_code", F.col("dev_device_class_num").isNotNull().alias("classed"))
    found = counted.join(known, "product_code", "left")
    sums = found.groupBy("l_returnflag").agg(
        F.sum("n").alias("n_lines"),
        F.sum(F.when(F.col("classed").isNotNull(), F.col("n")).otherwise(0)).alias("n_listed"),
        F.sum(F.when(F.col("classed"), F.col("n")).otherwise(0)).alias("n_classed"),
    )
    return sums.withColumn("pct_classed", F.round(100 * F.col("n_classed") / F.col("n_lines"), 1))


def backfill_links(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names linked exactly, by a curated list or by the longest parent name."""

    def named(c: Column) -> Column:
        k = c % 4
        return F.when(k == 0, F.concat(F.lit("ALPHA "), c)).when(k == 1, F.concat(F.lit("BRAVO "), c)).when(k == 2, F.concat(F.lit("GROUP "), c, F.lit(" WORKS EAST"))).otherwise(F.concat(F.lit("NOBODY "), c))

    c = F.col("c_custkey")
    customers = table(spark, sf, "customer").select("c_custkey")
    name = named(c).alias("name_key")
    key = lambda more: (c + more).cast("string").alias("gvkey")
    exact = customers.filter("c_custkey % 4 = 0").select(name, key(0))
    windowed = customers.filter("c_custkey % 8 = 0").select(name, key(1000000), F.lit(WINDOWED).alias("match_source"))
    other = customers.filter("c_custkey % 16 = 4 OR c_custkey % 4 = 1")
    other = other.select(name, F.when(c % 3 == 0, "UNMAPPED").otherwise((c + 2000000).cast("string")).alias("gvkey"), F.lit(OTHER).alias("match_source"))
    groups = customers.filter("c_custkey % 4 = 2")
    parents = groups.select(F.concat(F.lit("GROUP "), c).alias("name_key"), key(0)).unionAll(groups.filter("c_custkey % 3 <> 1").select(F.concat(F.lit("GROUP "), c, F.lit(" WORKS")).alias("name_key"), key(3000000)))
    recipients = table(spark, sf, "orders").select(named(F.col("o_custkey")).alias("name_key"))
    return linkage.backfill(exact, windowed.unionAll(other), recipients, parents).select("name_key", "gvkey", "match_source", "match_status")


QUERIES = {f.__name__: f for f in (adverse_reports, product_codes, product_code_coverage, backfill_links)}

CODES = """
    p AS (SELECT 'B' || (p_partkey % 400) AS product_code, CASE WHEN p_size % 4 = 0 THEN 'x' ELSE CAST(p_size % 4 AS VARCHAR) END AS c,
                 CASE p_partkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE '?' END AS f, CASE WHEN p_partkey % 5 <> 0 THEN 'seen' END AS note FROM part WHERE p_partkey % 7 <> 0),
    codes AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY c, f, note NULLS FIRST) = 1)
"""
LABEL = "CASE {0} % 4 WHEN 0 THEN 'ALPHA ' || {0} WHEN 1 THEN 'BRAVO ' || {0} WHEN 2 THEN 'GROUP ' || {0} || ' WORKS EAST' ELSE 'NOBODY ' || {0} END"

ORACLE_SQL = {
    "adverse_reports": """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS i, l_suppkey AS s FROM lineitem),
        h AS (SELECT l_orderkey, s FROM l WHERE s % 3 <> 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i) = 1),
        r AS (SELECT l_orderkey, count(*) AS n, string_agg(CASE l_returnflag WHEN 'R' THEN 'broke' WHEN 'N' THEN 'leaked' END, '; ' ORDER BY i) AS problems FROM l GROUP BY l_orderkey),
        o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) - 10 END AS event_date FROM orders)
        SELECT o_orderkey, 'MAKER ' || h.s || CASE WHEN h.s % 3 = 1 THEN ' EAST' ELSE '' END AS name_key, h.s AS gvkey, CASE WHEN h.s % 3 = 1 THEN 'B_prefix' ELSE 'A_exact' END AS link_tier,
               event_date, CAST(year(event_date) AS INT) AS year, CAST(n AS INT) AS n_devices_listed,
               CASE l.s % 3 WHEN 0 THEN 'Maker ' || l.s || ', Inc.' WHEN 1 THEN 'Maker ' || l.s || ' East LLC' ELSE 'Unknown ' || l.s END AS manufacturer_d_name,
               l_linestatus AS brand_name, CAST(l.s % 3 + 1 AS VARCHAR) AS device_class, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_patients_listed, problems AS product_problems
        FROM o JOIN h ON o_orderkey = h.l_orderkey JOIN l ON o_orderkey = l.l_orderkey AND i = 1 JOIN r ON o_orderkey = r.l_orderkey
        WHERE h.s % 5 <> 0 OR event_date IS NULL OR year(event_date) BETWEEN 1996 AND 1998
    """,
    "product_codes": f"""
        WITH {CODES} SELECT product_code, c AS dev_device_class, f AS dev_implant_flag, note AS dev_note, TRY_CAST(c AS INT) AS dev_device_class_num,
        CASE f WHEN 'Y' THEN true WHEN 'N' THEN false END AS dev_implant_flag_bool FROM codes
    """,
    "product_code_coverage": f"""
        WITH {CODES}, j AS (SELECT l_returnflag, product_code, c FROM lineitem LEFT JOIN codes ON product_code = 'B' || (l_partkey % 400))
        SELECT l_returnflag, count(*) AS n_lines, count(product_code) AS n_listed, count(*) FILTER (c <> 'x') AS n_classed, round(100 * count(*) FILTER (c <> 'x') / count(*), 1) AS pct_classed
        FROM j GROUP BY l_returnflag
    """,
    "backfill_links": f"""
        WITH r AS (SELECT DISTINCT o_custkey AS c, {LABEL.format("o_custkey")} AS name_key FROM orders),
        k AS (SELECT c_custkey AS c, {LABEL.format("c_custkey")} AS name_key FROM customer)
        SELECT name_key, CAST(c AS VARCHAR) AS gvkey, 'exact_normalized' AS match_source, 'matched' AS match_status FROM k WHERE c % 4 = 0 AND c % 8 <> 0
        UNION ALL SELECT name_key, CAST(c + 1000000 AS VARCHAR), '{WINDOWED}', 'matched' FROM r WHERE c % 8 = 0
        UNION ALL SELECT name_key, CASE WHEN c % 3 <> 0 THEN CAST(c + 2000000 AS VARCHAR) END, '{OTHER}', CASE WHEN c % 3 <> 0 THEN 'matched' ELSE 'resolved_unlisted_parent' END FROM r WHERE c % 4 = 1
        UNION ALL SELECT name_key, CASE WHEN c % 3 <> 1 THEN CAST(c + 3000000 AS VARCHAR) ELSE CAST(c AS VARCHAR) END, 'parent_prefix', 'matched' FROM r WHERE c % 4 = 2 AND (c % 3 <> 1 OR length('GROUP ' || c) >= 8)
    """,
}

"""File sources with the checks that a dated snapshot needs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "﻿"


class SchemaMismatch(ValueError):
    """Required columns are missing."""


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """File names in a folder of any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def latest_snapshot(spark: SparkSession, folder: str, pattern: str, required: bool = True) -> str | None:
    """The lexically last file whose whole name fits ``pattern``."""
    hits = [n for n in list_files(spark, folder) if re.fullmatch(pattern, n)]
    if hits:
        return f"{folder.rstrip('/')}/{hits[-1]}"
    if required:
        raise FileNotFoundError(f"nothing in {folder} fits {pattern}")
    return None


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name goes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    raw = reader.csv(path)
    raw = raw.withColumnsRenamed({c: c.removeprefix(BOM) for c in raw.columns if c.startswith(BOM)})
    if schema is not None:
        raw = conform(raw, schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    return raw.select(*[f"`{c}`" for c in columns]) if columns else raw


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project to ``columns``; raise with the names that are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaMismatch(f"missing columns: {missing}")
    return df.select(*[f"`{c}`" for c in columns])


def absent(df: DataFrame, schema: StructType) -> list[str]:
    return [f.name for f in schema if f.name not in df.columns]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, cast where possible; absent ones and values that do not parse are NULL."""
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def read_bulk_json(spark: SparkSession, path: str, schema: str, results: str = "results") -> DataFrame:
    """Nested bulk exports: one document per file with an array of records."""
    outer = f"{results} array<struct<{schema}>>"
    return spark.read.schema(outer).option("multiLine", True).json(path).select(F.inline(results))


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields as columns with dotted names, at every depth."""

    def walk(kind: StructType, path: str, name: str):
        for f in kind:
            at, full = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, at + ".", full + separator)
            else:
                yield F.col(at).alias(full)

    return df.select(*walk(df.schema, "", ""))


class PartialCache(RuntimeError):
    """A partitioned cache does not have the files that its manifest lists."""


def read_cached_parquet(spark: SparkSession, folder: str, expected_files: int, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A complete cache of Parquet chunks; a partial one is refused."""
    found = [n for n in list_files(spark, folder) if n.endswith(".parquet")]
    if len(found) != expected_files:
        raise PartialCache(f"{len(found)} chunks in {folder}, the manifest has {expected_files}")
    df = spark.read.schema(schema).parquet(folder)
    return df.select(*columns) if columns else df


def read_url_index(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated index of captures: url, timestamp."""
    return spark.read.option("sep", " ").schema("url string, timestamp string").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, needle: str, status: str = "200", mime: str | None = None) -> DataFrame:
    """JSON lines that contain ``needle``; malformed lines go; kept by status and mime type."""
    lines = spark.read.text(path).filter(F.col("value").rlike(needle))
    body = F.regexp_extract("value", r"(\{.*\})", 1)
    rows = lines.select(F.from_json(body, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    rows = rows.filter(F.col("_bad").isNull() & (F.col("status") == status)).drop("_bad")
    return rows.filter(F.col("mime") == mime) if mime else rows


_FILING_COLUMNS = {"accessionNumber": "accession", "form": "form", "filingDate": "filing_date", "reportDate": "report_date", "primaryDocument": "document"}


def read_filings(spark: SparkSession, path: str, forms: list[str], since: int, shards: str | None = None) -> DataFrame:
    """Issuer submissions, whose filings are parallel arrays, as rows; filtered by form and year.

    The recent ones are in the issuer's file.  It names further files with the
    older ones, which are read from ``shards`` (a folder or pattern): a file
    that no issuer names is left out, and one that is named but not there is an
    error.  A filing in both counts once.
    """
    arrays = ", ".join(f"{k} array<string>" for k in _FILING_COLUMNS)
    schema = f"cik string, name string, sic string, filings struct<recent struct<{arrays.replace(' array', ': array')}>, files: array<struct<name: string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    zipped = lambda prefix: F.arrays_zip(*[F.col(prefix + k).alias(v) for k, v in _FILING_COLUMNS.items()])
    rows = raw.select("cik", "name", "sic", F.inline(zipped("filings.recent.")))
    if shards:
        named = raw.select("cik", "name", "sic", F.explode("filings.files.name").alias("__file")).distinct()
        older = spark.read.schema(arrays).option("multiLine", True).json(shards)
        blocks = older.select(F.col("_metadata.file_name").alias("__file"), zipped("").alias("__rows"))
        both = named.join(blocks, "__file", "left")
        told = F.coalesce("__rows", F.raise_error(F.concat(F.lit("no such shard of filings: "), F.col("__file"))).cast(blocks.schema["__rows"].dataType))
        rows = rows.unionByName(both.select("cik", "name", "sic", F.inline(told)))
    dated = rows.withColumns({c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in ("filing_date", "report_date")})
    kept = dated.filter(F.col("form").isin(*forms) & (F.year("filing_date") >= since))
    return kept.dropDuplicates(["cik", "accession"]) if shards else kept


def union_keyed_tables(spark: SparkSession, paths: list[str], key: str, columns: list[str]) -> DataFrame:
    """(key, columns) of every CSV that has the key; tables without it are passed over."""
    out = None
    for path in paths:
        df = read_csv(spark, path)
        if key in df.columns:
            part = df.select(key, *[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise SchemaMismatch(f"no table has {key}")
    return out.distinct()


def read_documents_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One document per text file: name and text."""
    names = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name")
    return spark.read.text(folder, wholetext=True).select(names, F.col("value").alias("text"))


def read_excel(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet by pandas where its reader is installed; for small curated files only."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.where(frame.notna(), None))


def read_sql(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A remote table; Spark pushes filters and columns down to it."""
    return spark.read.jdbc(url, table, properties=properties or {})

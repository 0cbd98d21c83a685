"""Sinks: CSV, Parquet by partition, manifests, tables for people, a file per document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's on any Hadoop file system."""
    at, fs = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, compression: str | None = None, single: bool = False) -> None:
    """CSV with header; ``single`` for small published tables only, since one task then writes all."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; partitions of the new rows replace old ones, others stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    write_text(spark, path, json.dumps(facts, indent=2, sort_keys=True, default=str) + "\n")


def cell(value: object, decimals: int = 1) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    return f"{value:,.{decimals}f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)


def percent(part: float, whole: float) -> str:
    return f"{part / whole:.1%}" if whole else "n/a"


def to_markdown(df: DataFrame, decimals: int = 1, most: int = 1000) -> str:
    """A table for people; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for people")
    escape = lambda x: cell(x, decimals).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(escape(v) for v in r) + " |" for r in rows]) + "\n"


# Characters with a meaning in LaTeX.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(text: str) -> str:
    return "".join(TEX.get(c, c) for c in text)


def to_latex(df: DataFrame, decimals: int = 1, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for people")
    line = lambda values: " & ".join(tex_escape(v) for v in values) + r" \\"
    body = [line([cell(v, decimals) for v in r]) for r in rows]
    head = [rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", line(df.columns), r"\midrule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder for each sheet of a workbook (no spreadsheet writer is needed)."""
    for name, df in sheets.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}", single=True)


def write_documents(df: DataFrame, folder: str, name: str, text: str) -> int:
    """One folder partition per document name; documents not in ``df`` any more go.  Returns the number removed."""
    spark = df.sparkSession
    at, fs = file_system(spark, folder)
    wanted = df.select(F.regexp_replace(F.col(name), r"[^\w.-]", "_").alias("document"), F.col(text).alias("value"))
    wanted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").text(folder)
    # Folders that have no document any more; only these come to the driver.
    held = [(status.getPath().getName().removeprefix("document="),) for status in fs.listStatus(at) if status.getPath().getName().startswith("document=")]
    stale = spark.createDataFrame(held, "document string").join(wanted.select("document").distinct(), "document", "left_anti") if held else None
    removed = 0
    for r in stale.toLocalIterator() if held else ():
        removed += bool(fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"document={r['document']}"), True))
    return removed

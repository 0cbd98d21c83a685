"""Token ids in ORC files.

Documents are dealt to files by ranges of doc_id and sorted, so that every
file, stripe and row group covers its own range of ids.  A row holds the ids as
an integer list, which ORC stores by run-length encoding.  Row indexes (one
entry each ``INDEX_STRIDE`` rows) and a Bloom filter on doc_id let readers skip
stripes and row groups; stripes are small enough to be read in parallel.

Each row also holds how many ids its file has before it.  A reader therefore
gets a document's place in the whole id stream from the totals of the files
before, without sorting again.

Defined cases: a null text is empty and has the end id alone; an empty table
gives files without rows; rows that repeat a doc_id follow in the order of
their texts; a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, documents, scratch_path, stored
from .tokens import Encoder, TokenizerSpec, end_with, slices

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
SCHEMA = "doc_id long, first long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, spec: TokenizerSpec, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and write ORC files in ascending doc_id order."""
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder.of(spec), 0
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                offsets, ids = end_with(*encoder.encode(texts.slice(low, high - low)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                doc = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(before + offsets[:-1].astype(np.int64)), lists], names=["doc_id", "first", "ids"]
                )
                before += len(ids)

    writer = ordered.mapInArrow(run, SCHEMA).write
    options = {
        "orc.stripe.size": STRIPE_BYTES,
        "orc.create.index": "true",
        "orc.row.index.stride": INDEX_STRIDE,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": BLOOM_FPP,
        "compression": "zstd",
    }
    with arrow_rows(docs.sparkSession, 1500):
        writer.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, first (ids before it in its file), ids and part (the file's number) of every document.

    A filter on doc_id reaches the files' statistics, row indexes and Bloom filters.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "first", "ids", part.alias("part"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from what ``read_token_orc`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])), np.int64, len(batch))
            sizes = pa.array(np.diff(ends).astype(np.int64))
            columns = [batch.column("doc_id"), batch.column("first"), batch.column("part"), sizes, pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "part", "n_tokens", "ids_crc32"])

    with arrow_rows(tokens.sparkSession, 1000):
        rows = stored(
            tokens.mapInArrow(run, "doc_id long, first long, part int, n_tokens long, ids_crc32 long"), "token-digests"
        )
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(files, "part").select(
        "doc_id", (F.col("__before") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_orc(docs: DataFrame, spec: TokenizerSpec, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` to ORC in the shared folder and digest them from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-orc")
    write_token_orc(docs, path, spec, end_id)
    return token_digests(read_token_orc(spark, path))

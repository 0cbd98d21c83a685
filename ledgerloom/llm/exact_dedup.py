"""Exact deduplication over an extendible-hash index on shared files.

The directory starts with one bucket of 64-bit keys.  Counts of distinct keys
by their leading bits tell which buckets hold more than ``capacity`` keys; such
a bucket splits by its next bit, and the directory doubles whenever a bucket as
deep as the directory splits.  Counting goes on bit by bit for the buckets that
are still overfull, until none is or a bucket is one key.

Buckets follow one another in the order of their keys, and consecutive buckets
belong to one owner task.  Every document goes straight to the owner of its
bucket.  There the documents are in the order of bucket, key and text, so that
the owner compares the bytes of the texts that share a key, chains different
texts that collide, and gives each document the one that stays.  What the
owners find is the index: one file an owner, in the order of buckets.

A text with more than a thousandth of the rows (so fewer than a thousand texts)
is aggregated where it is read and goes to its owner as one entry; its
documents are looked up in the index by bucket, key and digest.

Defined cases: a null text counts as the empty text; an empty table gives an
empty result; rows that repeat a doc_id and its text count as copies of one
another and all carry ``kept`` if that doc_id stays (``keep_one`` leaves one
of them); a null doc_id is smaller than any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, documents, scratch_path, stored

#: Keys that a bucket holds before it splits.
CAPACITY = 8_192
#: Bits by which keys are counted at once.
STEP = 12
#: Leading bits that the literal directory has slots for; deeper buckets are told apart within their slot.
TOP_BITS = 16
#: Buckets of one owner task, about, where there are more than shuffle partitions.
OWNED = 8
BITS = 64


@dataclass(frozen=True)
class Directory:
    """Leaf buckets by (depth, leading bits) in the order of keys; ``doublings`` is the global depth."""

    doublings: int
    leaves: tuple[tuple[int, int], ...]

    def slots(self) -> list[int]:
        """The bucket number of each of the 2 ** doublings directory slots."""
        out = []
        for number, (depth, _) in enumerate(self.leaves):
            out += [number] * (1 << (self.doublings - depth))
        return out

    def starts(self) -> list[int]:
        """The first key of each bucket, as an unsigned number."""
        return [prefix << (BITS - depth) for depth, prefix in self.leaves]


def leading_bits(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def grow_directory(count: Callable[[int, list[int], int], dict[int, int]], capacity: int) -> Directory:
    """Split overfull buckets.

    ``count(depth, prefixes, bits)`` gives the number of distinct keys by their
    first depth + bits bits, of the keys whose first depth bits are in ``prefixes``.
    """
    leaves: list[tuple[int, int]] = []
    overfull, depth, most = [0], 0, capacity << STEP
    while overfull:
        # No more bits at once than the fullest bucket asks for.
        bits = min(STEP, BITS - depth, max(1, (most // capacity).bit_length()))
        by_prefix: dict[int, dict[int, int]] = {p: {} for p in overfull}
        for k, n in count(depth, overfull, bits).items():
            by_prefix[k >> bits][k] = n
        waiting = [(depth, p, by_prefix[p]) for p in overfull]
        overfull, most = [], 0
        while waiting:
            at, prefix, held = waiting.pop()
            if sum(held.values()) <= capacity or at == BITS:
                leaves.append((at, prefix))
            elif at == depth + bits:
                overfull.append(prefix)
                most = max(most, sum(held.values()))
            else:
                bit = depth + bits - at - 1
                for half in (2 * prefix, 2 * prefix + 1):
                    waiting.append((at + 1, half, {k: n for k, n in held.items() if k >> bit == half}))
        depth += bits
    leaves.sort(key=lambda x: x[1] << (BITS - x[0]))
    return Directory(max(d for d, _ in leaves), tuple(leaves))


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def bucket_of(key: Column, directory: Directory) -> Column:
    """The bucket of a key: its slot of the directory's first bits, and the buckets that start in that slot up to the key."""
    top = min(directory.doublings, TOP_BITS)
    starts, table, at = directory.starts(), [], 0
    for slot in range(1 << top):
        low, high = slot << (BITS - top), (slot + 1) << (BITS - top)
        while at + 1 < len(starts) and starts[at + 1] <= low:
            at += 1
        first = at
        while at + 1 < len(starts) and starts[at + 1] < high:
            at += 1
        # Numbers compare as signed, so the first bit is turned over.
        table.append({"first": first, "starts": [_signed(s ^ (1 << (BITS - 1))) for s in starts[first + 1 : at + 1]]})
    slots = F.from_json(F.lit(json.dumps(table)), "array<struct<first:int,starts:array<bigint>>>")
    own = F.get(slots, leading_bits(key, top).cast("int"))
    turned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return own["first"] + F.size(F.filter(own["starts"], lambda s: s <= turned))


@dataclass(frozen=True)
class ExactIndex:
    """``entries``: stored rows in the owners' files (``path``); ``rows``: doc_id, key, sha of all documents; ``hot``: (key, sha, n)."""

    path: str
    entries: DataFrame
    rows: DataFrame
    hot: DataFrame
    directory: Directory


def hash_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, payload: list[str], capacity: int = CAPACITY, key: Callable[[Column], Column] = hash_key) -> ExactIndex:
    """The index of ``docs`` (doc_id, text, payload).  An entry is a document, or a text of many documents (``entry_rows`` > 1).

    Entries have bucket, key, chain, sha, keep_id, group_size, place (from 1 among the equal texts, the one that
    stays first), doc_id and the payload.
    """
    rows = stored(docs.select("doc_id", key(F.col("text")).alias("key"), F.sha2("text", 256).alias("sha")), "dedup-rows")
    keys = stored(rows.select("key").distinct(), "dedup-keys")

    def count(depth: int, prefixes: list[int], bits: int) -> dict[int, int]:
        k = keys
        if depth:  # the overfull buckets only
            wanted = F.from_json(F.lit(str([_signed(p) for p in prefixes])), "array<bigint>")
            k = keys.filter(F.array_contains(wanted, leading_bits(F.col("key"), depth)))
        found = k.groupBy(leading_bits(F.col("key"), depth + bits).alias("p")).count()
        # At most 2 ** STEP numbers for each overfull bucket; buckets follow the number of distinct texts.
        return {r["p"] % (1 << BITS): r["count"] for r in found.collect()}

    directory = grow_directory(count, capacity)
    total = rows.count()
    hot = rows.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, int(total * HOT_SHARE)))
    hot = stored(hot, "dedup-hot")  # fewer than 1 / HOT_SHARE rows
    buckets = len(directory.leaves)
    owners = min(buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // OWNED)))

    keyed = docs.withColumns({"__key": key(F.col("text")), "__sha": F.sha2("text", 256)})
    is_hot = [F.col("__key") == hot["key"], F.col("__sha") == hot["sha"]]
    cold = keyed.join(F.broadcast(hot), is_hot, "left_anti").withColumn("__n", F.lit(1).cast("long"))
    grouped = keyed.join(F.broadcast(hot), is_hot, "left_semi").groupBy("__key", "__sha", "text")
    least = F.lit(-(1 << 63))
    first = F.struct(F.coalesce("doc_id", least).alias("at"), F.struct("doc_id", *payload).alias("row"))
    packed = grouped.agg(F.max_by(first["row"], first["at"]).alias("__row"), F.count(F.lit(1)).alias("__n"))
    packed = packed.select("__row.*", "text", "__key", "__sha", "__n")
    both = cold.unionByName(packed.select(*cold.columns)).withColumn("__bucket", bucket_of(F.col("__key"), directory))
    # Consecutive buckets to one owner: key ranges, in the order of owners.
    both = both.withColumn("__owner", F.floor(F.col("__bucket") * owners / buckets).cast("int"))
    owned = both.repartitionById(owners, F.col("__owner"))
    group = ["__owner", "__bucket", "__key"]
    by_text = Window.partitionBy(*group, "text")
    placed = owned.withColumns(
        {
            "place": F.row_number().over(by_text.orderBy(F.desc_nulls_last("doc_id"))),
            "keep_id": F.max("doc_id").over(by_text),
            "group_size": F.sum("__n").over(by_text),
        }
    )
    # Different texts with one key are numbered in the order of their bytes.
    chained = placed.withColumn("chain", F.dense_rank().over(Window.partitionBy(*group).orderBy("text")))
    out = chained.select(
        F.col("__bucket").alias("bucket"), F.col("__key").alias("key"), "chain", F.col("__sha").alias("sha"),
        "keep_id", "group_size", "place", F.col("__n").alias("entry_rows"), "doc_id", *payload,
    )
    path = scratch_path(docs.sparkSession, "dedup-index")
    out.write.parquet(path)
    return ExactIndex(path, docs.sparkSession.read.schema(out.schema).parquet(path), rows, hot, directory)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = hash_key) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key, bucket, chain."""
    base = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    index = build_index(base, [], capacity, key)
    found = ["keep_id", "group_size", "sha", "key", "bucket", "chain"]
    alone = index.entries.filter("entry_rows = 1").select("doc_id", *found)
    texts = index.entries.filter("entry_rows > 1").select(*found)  # the hot texts, fewer than 1 / HOT_SHARE
    looked_up = index.rows.withColumn("bucket", bucket_of(F.col("key"), index.directory)).join(F.broadcast(texts), ["bucket", "key", "sha"])
    return alone.unionByName(looked_up.select("doc_id", *found)).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "key",
        "bucket",
        "chain",
    )


def keep_one(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = hash_key) -> DataFrame:
    """``docs`` with its own columns, one row of each group of equal texts: that with the largest doc_id.

    The columns go to the owner with the text, so that the index holds the rows that stay.
    """
    columns = docs.columns
    whole = F.struct(*[docs[f"`{c}`"] for c in columns]).alias("__row")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), whole)
    kept = build_index(base, ["__row"], capacity, key).entries.filter("place = 1")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in columns])

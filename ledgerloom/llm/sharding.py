"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Documents belong to source partitions by a hash of their id.  Shard sizes are
fixed first: equal, or one more.  The number of rows that partition p sends to
shard s is drawn from the multivariate hypergeometric distribution, row after
row of the matrix, given what the shards still take: that is the law of a
uniform random permutation.  A partition permutes its rows by a keyed hash and
cuts the order by its row of the matrix; a shard permutes what it gets by a
second keyed hash.  The draw depends on the seed and the ids alone, not on how
files are split.

Law: ``rows`` (row counts of the shards differ by one at most).

Defined cases: a null text has no bytes (size 8, crc of nothing); an empty
table gives an empty result; repeated rows are placed one by one; a null
doc_id is an id like any other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, inline_rows, ranked, stored

SHARDS = 24
SEED = 20240613
#: Rows of the matrix.  Fixed: the matrix has SOURCES * SHARDS cells whatever the input.
SOURCES = 1024
#: Parts of the key space within a shard (ranked on their own), at least.
BLOCKS = 64
BLOCK_ROWS = 100_000


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact counts [source, shard]; row sums are ``rows``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(rows.sum())
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        drawn = 0
        left = int(room.sum())
        for s in range(shards):  # one hypergeometric draw a cell
            want = int(n) - drawn
            left -= int(room[s])
            out[p, s] = _draw(rng, int(room[s]), left, want)
            drawn += int(out[p, s])
        room -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; past the generator's limit of 10**9 by inversion of the same law."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _invert(rng, good, bad, n)


def _invert(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric by its distribution around the mode, from the ratios of neighbours.

    What lies more than twelve deviations and fifty away has less weight than
    the last bit of a random double.
    """
    total = good + bad
    mode = (good + 1) * (n + 1) // (total + 2)
    reach = 50 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    k = np.arange(max(0, n - bad, mode - reach), min(good, n, mode + reach) + 1, dtype=np.float64)
    at = k[:-1]
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - at) / (bad - n + at + 1) * ((n - at) / (at + 1))))])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(upto, rng.random() * upto[-1], side="right"), len(k) - 1)])


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, sources: int = SOURCES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    base = documents(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    source = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(sources)).cast("int")
    rows = stored(base.withColumn("source", source), "shard-rows")
    held = np.zeros(sources, dtype=np.int64)
    for r in rows.groupBy("source").count().collect():  # ``sources`` rows at most
        held[r["source"]] = r["count"]
    ends = np.cumsum(communication_matrix(held, shards, seed), axis=1)
    cuts = inline_rows(spark, [{"source": p, "ends": e.tolist()} for p, e in enumerate(ends)], "source int, ends array<long>")
    ties = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    most = int(held.max(initial=1))

    def block(key, expected: int):
        return F.shiftrightunsigned(key, 40).cast("long") % F.lit(max(1, -(-expected // BLOCK_ROWS)))

    key = F.xxhash64(F.lit(seed + 1), "doc_id")
    local = ranked(rows, ["source"], [key, *ties], block(key, most), "__local")
    sent = local.join(F.broadcast(cuts), "source").withColumn(
        "shard", F.size(F.filter("ends", lambda e: e <= F.col("__local"))).cast("int")
    )
    sent = stored(sent.select("doc_id", "size", "text_crc32", "shard"), "shard-sent")
    key = F.xxhash64(F.lit(seed + 2), "doc_id")
    blocks = max(BLOCKS, -(-int(held.sum()) // shards // BLOCK_ROWS))
    placed = ranked(sent, ["shard"], [key, *ties], F.shiftrightunsigned(key, 24) % F.lit(blocks), "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

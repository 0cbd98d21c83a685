"""SimHash near-duplicates found by Golay-code fuzzy keys.

Fingerprint: 64 bits, a bit is 1 if set in over half of the XXH64 hashes (seed
42) of the text's 3-word shingles.  Two fingerprints link at two or fewer
differing bits; a document's component is all that links reach.

Keys.  A fingerprint has segments of 22, 21 and 21 bits.  Two differing bits
leave one segment without a difference, and one of the other two with one at
most (pigeonhole).  So for the ordered pairs of segments (i, j) = (1, 2),
(2, 3), (3, 1) a key is j's bits with the index of a codeword near i: the
binary Golay code of length 23 is perfect, so each word is within three bits of
one codeword.  A word three bits away also gets the five codewords that are four
bits away; then any two words that differ in one bit share an index.

Distinct fingerprints meet by key and the distance is verified.  A key that
more than ``FULL`` of them share is dense: there, instead of pairs, each
fingerprint meets others at the words one bit flip away (two are within two
bits exactly if they share such a word, and at most 65 share one), so the work
stays linear and no link is lost.  Links within a meeting point form a star.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; fewer than three words give one shingle of them all; repeated rows
count as documents of their own; null doc_ids are larger than any other in
choosing the smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, keyed_join, stored
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: (first bit, bits) of the segments, and the ordered pairs (near, equal) that make keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Fingerprints that share a key before it counts as dense.
FULL = 24
#: Hashes whose bits are counted at once.
CHUNK = 200_000


def shingle_hashes(text: str | bytes) -> np.ndarray:
    """XXH64 of the shingles; bytes.lower and bytes.split know ASCII only, as the words ask for."""
    from xxhash import xxh64_intdigest as h

    data = text.encode() if isinstance(text, str) else text
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.fromiter((h(s, SEED) for s in shingles), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint's bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"")) for t in texts), np.uint64, len(batch))
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "fp"])

    return documents(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(generator rows, syndrome of each bit, coset leader of each syndrome) of the binary Golay code of length 23."""
    g = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    power = []
    for i in range(23):
        x = 1 << i
        for d in range(22, 10, -1):
            if x >> d & 1:
                x ^= g << (d - 11)
        power.append(x)
    syndrome = np.array(power, np.int64)
    leader = np.zeros(1 << 11, np.int64)
    one = [1 << i for i in range(23)]
    for i in range(23):
        leader[syndrome[i]] = one[i]
        for j in range(i):
            leader[syndrome[i] ^ syndrome[j]] = one[i] | one[j]
            for k in range(j):
                leader[syndrome[i] ^ syndrome[j] ^ syndrome[k]] = one[i] | one[j] | one[k]
    rows = np.array([g << i for i in range(12)], np.int64)
    return rows, syndrome, leader


@cache
def _heavy() -> np.ndarray:
    """Codewords of weight 7."""
    rows, _, _ = _golay()
    words = np.zeros(1, np.int64)
    for r in rows:
        words = np.concatenate([words, words ^ r])
    return words[np.bitwise_count(words) == 7]


@cache
def _far() -> tuple[np.ndarray, np.ndarray]:
    """(row of each syndrome, or -1; [row, 5] error words of weight four with that syndrome)."""
    _, syndrome, leader = _golay()
    row = np.full(1 << 11, -1, np.int64)
    three = np.flatnonzero(np.bitwise_count(leader) == 3)
    row[three] = np.arange(len(three))
    heavy = _heavy()
    far = np.array([heavy[(heavy & leader[s]) == leader[s]] ^ leader[s] for s in three])
    return row, far


def _syndromes(words: np.ndarray) -> np.ndarray:
    _, syndrome, _ = _golay()
    out = np.zeros(len(words), np.int64)
    for i in range(23):
        out ^= np.where(words >> i & 1, syndrome[i], 0)
    return out


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, index) of every word's codewords: one, or six if it is three bits from the nearest."""
    _, _, leader = _golay()
    row, far = _far()
    s = _syndromes(words)
    near = words ^ leader[s]
    wide = np.flatnonzero(row[s] >= 0)
    more = words[wide, None] ^ far[row[s[wide]]]
    which = np.concatenate([np.arange(len(words)), np.repeat(wide, far.shape[1])])
    return which, np.concatenate([near, more.ravel()]) >> 11  # the code is systematic in the upper 12 bits


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the Golay keys of every fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
            for number, (near, equal) in enumerate(PAIRS):
                which, index = golay_indices(parts[near])
                key = (np.int64(number) << 40) | (index << 22) | parts[equal][which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fps[which].view(np.int64))], names=["key", "fp"]
                )

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints whose components are those of all links.  ``distinct``: stored, column fp."""
    keys = stored(fuzzy_keys(distinct), "golay-keys")
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "golay-sizes")
    full = sizes.filter(F.col("n") > FULL)
    meet = keys.join(sizes.filter(F.col("n") <= FULL).select("key"), "key")
    held = meet.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))  # FULL at most
    pair = F.inline(
        F.flatten(
            F.transform(
                "fps",
                lambda a: F.transform(
                    F.filter("fps", lambda b: (a < b) & _close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))
                ),
            )
        )
    )
    sparse = held.select(pair)
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    dense = keys.join(full.select("key"), "key", "left_semi").select("fp").distinct()
    hubs = dense.select("fp", F.explode(flips).alias("word"))
    star = hubs.groupBy("word").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    star = star.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return sparse.unionByName(star).distinct()


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp, n (rows with that fingerprint), root, component_id and component_size."""
    with arrow_rows(docs.sparkSession, 1000):
        rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fp-classes")
    edges = stored(links(distinct), "fp-links")
    roots = components(edges)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    classes = stored(classes.join(groups, "root").select("fp", "n", "root", "component_id", "component_size"), "fp-components")
    return keyed_join(rows, classes, ["fp"], "n", rows.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (least doc_id reachable), component_size, copies."""
    return classified(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
        F.col("n").alias("copies"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns: one document of each component, that with the least doc_id.

    Where that doc_id has several texts in the component, the one with the least hash of its text stays.
    """
    columns = docs.columns
    least = F.lit(-(1 << 63))  # stands for a null doc_id
    found = classified(docs)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("th").alias("__th"), F.min("doc_id").alias("__at"))
    stay = stay.select(F.coalesce("__at", least).alias("__id"), "__th").distinct()
    text = docs["text"].cast("string")
    rows = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), least), "__th": F.xxhash64(text)})
    kept = rows.join(stay.hint("merge"), ["__id", "__th"], "left_semi")
    return kept.dropDuplicates(["__id", "__th"]).select(*[f"`{c}`" for c in columns])

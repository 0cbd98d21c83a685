import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup
from ledgerloom.llm.common import documents

from .conftest import TEXTS, strip


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def weak_key(text):
    """Sixteen keys for all texts, so that different texts collide."""
    return F.pmod(F.xxhash64(text), F.lit(16)) * F.lit(1 << 59) - F.lit(1 << 62)


def test_matches_brute_force(docs, clashing):
    want = brute(TEXTS)
    assert strip(exact_dedup.exact_dedup(docs).select(*COLUMNS).collect()) == want
    assert strip(exact_dedup.exact_dedup(clashing).select(*COLUMNS).collect()) == want


def test_small_buckets_split(docs):
    base = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    index = exact_dedup.build_index(base, [], capacity=2)
    assert index.directory.doublings >= 2
    held = index.entries.groupBy("bucket").agg(F.countDistinct("key").alias("n")).collect()
    assert max(r.n for r in held) <= 2


def many(spark, groups=400, copies=3000):
    """Texts with one to four copies, one text with more than a third of the rows, and a few that fill a hot row each."""
    rows = [(10 * g + c, f"text number {g}") for g in range(groups) for c in range(1 + g % 4)]
    rows += [(100_000 + k, "the hot text") for k in range(copies)] + [(None, "the hot text"), (None, None), (7, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_many_splits_hot_text_and_collisions(spark):
    rows, df = many(spark)
    want = brute(rows)
    for key in (exact_dedup.hash_key, weak_key):
        found = exact_dedup.exact_dedup(df, 8, key)
        assert strip(found.select(*COLUMNS).collect()) == want
        chains = found.groupBy("key").agg(F.max("chain").alias("n"), F.countDistinct("text_sha256").alias("texts")).collect()
        assert all(r.n == r.texts for r in chains)
        kept = exact_dedup.keep_one(df, 8, key).collect()
        assert Counter(r.text or "" for r in kept) == Counter({t or "" for _, t in rows})
        assert {r.doc_id for r in kept if r.text == "the hot text"} == {100_000 + 2999}


def test_owners_hold_key_ranges(spark):
    _, df = many(spark)
    base = documents(df).withColumn("text", F.coalesce("text", F.lit("")))
    index = exact_dedup.build_index(base, [], 8)
    assert len(index.directory.leaves) > 30
    # The key's order is that of the unsigned number; files follow one another in the order of owners.
    number = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    spans = index.entries.groupBy(F.input_file_name().alias("f")).agg(F.min(number).alias("low"), F.max(number).alias("high")).orderBy("f").collect()
    assert len(spans) > 1 and all(a.high < b.low for a, b in zip(spans, spans[1:]))
    # The bucket of the directory is the one whose range holds the key.
    starts = [s - (1 << 63) for s in index.directory.starts()]
    for r in index.entries.select("bucket", number.alias("k")).collect():
        assert starts[r.bucket] <= r.k and (r.bucket + 1 == len(starts) or r.k < starts[r.bucket + 1])


def counter(keys):
    def count(depth, prefixes, bits):
        found = Counter(k >> (64 - depth - bits) for k in keys if not depth or k >> (64 - depth) in prefixes)
        return dict(found)

    return count


def test_directory_covers_the_key_space_and_splits_until_buckets_fit():
    import random

    rng = random.Random(4)
    keys = {rng.getrandbits(64) for _ in range(5000)} | {(5 << 50) + i for i in range(300)}  # many that differ late
    directory = exact_dedup.grow_directory(counter(keys), 20)
    starts = directory.starts()
    assert starts[0] == 0 and starts == sorted(starts)
    ends = [*starts[1:], 1 << 64]
    assert all(b - a == 1 << (64 - d) for a, b, (d, _) in zip(starts, ends, directory.leaves))
    assert max(sum(a <= k < b for k in keys) for a, b in zip(starts, ends)) <= 20
    small = exact_dedup.grow_directory(counter({rng.getrandbits(64) for _ in range(500)}), 20)
    assert len(small.slots()) == 1 << small.doublings and small.slots() == sorted(small.slots())
    assert exact_dedup.grow_directory(counter(set()), 20).slots() == [0]


def test_keys_that_differ_late_get_their_bucket(spark):
    """The directory is then too deep for a literal of its slots."""
    rows = [(i, f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    late = lambda text: F.substr(text, F.lit(2)).cast("long") + F.lit(-5)
    assert strip(exact_dedup.exact_dedup(df, 4, late).select(*COLUMNS).collect()) == brute(rows)


def test_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.keep_one(nothing).collect() == []


def test_keep_one_leaves_one_row_of_each_text(docs, clashing):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    best = {}
    for i, t in TEXTS:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    want = sorted(((None if i == -1 else i, t) for t, i in best.items()), key=repr)
    assert got == want
    assert exact_dedup.keep_one(clashing).columns == clashing.columns

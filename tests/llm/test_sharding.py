import zlib
from collections import Counter

import numpy as np

from ledgerloom.llm import sharding

from .conftest import TEXTS, strip


def test_matrix_has_exact_margins():
    rows = np.array([5, 0, 17, 100, 3])
    m = sharding.communication_matrix(rows, 7, 1)
    assert (m >= 0).all() and (m.sum(axis=1) == rows).all()
    columns = m.sum(axis=0)
    assert columns.max() - columns.min() <= 1


def test_matrix_follows_the_hypergeometric_mean():
    rows = np.array([30, 70])
    mean = np.mean([sharding.communication_matrix(rows, 4, s) for s in range(400)], axis=0)
    assert np.abs(mean - np.outer(rows, np.full(4, 0.25))).max() < 0.6


def check(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and all(0 <= r.shard < 24 for r in rows)
    counts = [sizes.get(s, 0) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_contract(docs, clashing, nothing):
    rows = sharding.shard_documents(docs).collect()
    check(rows, len(TEXTS))
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows") for i, t in TEXTS), key=repr)
    assert strip(r[:4] for r in rows) == want
    assert all(r.grown_shard is None for r in rows)
    assert strip(sharding.shard_documents(clashing).collect()) == strip(rows)
    assert sharding.shard_documents(nothing).collect() == []


def test_layout_of_the_input_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sharding.shard_documents(docs.repartition(1)).collect()
    b = sharding.shard_documents(docs.repartition(7)).collect()
    assert strip(a) == strip(b)
    check(a, docs.count())


def test_shuffle_is_about_uniform(spark):
    docs = spark.range(4800).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    rows = sharding.shard_documents(docs).collect()
    by_shard = np.zeros((24, 8))
    for r in rows:
        by_shard[r.shard, r.doc_id * 8 // 4800] += 1
    expected = 200 / 8
    assert ((by_shard - expected) ** 2 / expected).sum() < 168 + 5 * (2 * 168) ** 0.5
    order = np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]
    assert abs(order) < 0.06


def test_draws_past_the_generators_limit_follow_the_law():
    from math import comb

    rng = np.random.default_rng(3)
    draws = Counter(sharding._draw(rng, 10**9, 49 * 10**9, 10) for _ in range(20_000))
    for k in range(4):  # so large an urn that draws are as good as independent
        assert abs(draws[k] / 20_000 - comb(10, k) * 0.02**k * 0.98 ** (10 - k)) < 0.015
    small = Counter(sharding._invert(rng, 5, 7, 6) for _ in range(20_000))
    for k in range(7):
        assert abs(small[k] / 20_000 - comb(5, k) * comb(7, 6 - k) / comb(12, 6)) < 0.02
    large = [sharding._draw(rng, 2 * 10**9, 46 * 10**9, 47 * 10**6) for _ in range(4000)]
    mean, var = 47e6 / 24, 47e6 / 24 * 23 / 24 * (1 - 47 / 48_000)
    assert abs(np.mean(large) - mean) < 5 * (var / 4000) ** 0.5 and abs(np.var(large) / var - 1) < 0.12
    wide = sharding._draw(rng, 5 * 10**9, 5 * 10**9, 9_999_999_999)
    assert wide in (5 * 10**9 - 1, 5 * 10**9)

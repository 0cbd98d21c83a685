import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    size = max(4, -(-max(len(r[1]) for r in kept) // 4) * 4)
    kept = [(i, [math.floor(1024 * x) for x in v] + [0] * (size - len(v)), k) for i, v, k in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = size // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [[list(v) for v in own[:entries]] for own in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut[p]:
                groups[nearest(v, books[p])[1]].append(v)
            for i, own in groups.items():
                books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(v, books[p]) for v in cut[p]] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(found[p][k][0] for p in range(parts)) for k in range(len(kept))]
    by_label = defaultdict(int)
    for e, (_, _, label) in zip(errors, kept):
        by_label[label] += e
    out = [(i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), errors[k], by_label[label], digest) for k, (i, _, label) in enumerate(kept)]
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=repr)


def made(n, size, seed):
    draw = random.Random(seed)
    return [(i * 3 % n, [round(draw.gauss(0, 0.3) * 4096) / 4096 for _ in range(size)], draw.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_matches_brute_force(spark):
    rows = made(500, 8, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "code", "error", "n", "no_label", "a.b")})
    assert run(df.repartition(5)) == slow(rows)


def test_ties_copies_and_odd_rows(spark):
    same = [0.25, -0.5, 0.75, 0.5]
    rows = [(i, same, 1) for i in range(300)] + made(40, 4, 4)  # equal entries: the first is taken, others stay unused
    rows += [(900, None, 1), (901, [0.1, None], 1), (902, [math.nan] * 4, 1), (903, [-math.inf] * 4, 1), (None, [0.5, 0.5], None), (7, [0.5], 9), (8, [], 9)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == slow(rows)


def test_few_and_none(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    rows = [(5, [0.1, 0.2, 0.3, 0.4, 0.5], None), (4, [0.1] * 5, None)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark.createDataFrame([(0, [1e30, 0.0, 0.0, 0.0], 1)], SCHEMA))

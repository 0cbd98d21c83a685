import random

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.common import stored

from .conftest import TEXTS, strip


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def slow(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=repr)


def test_matches_brute_force(docs, clashing):
    columns = ["doc_id", "fingerprint", "component_id"]
    assert strip(simhash.near_duplicates(docs).select(*columns).collect()) == slow(TEXTS)
    assert strip(simhash.near_duplicates(clashing).select(*columns).collect()) == slow(TEXTS)


def test_one_changed_bit_shares_a_golay_index():
    words = np.array([random.Random(7).getrandbits(22) for _ in range(500)])

    def indices(w):
        out = {}
        for which, index in zip(*simhash.golay_indices(w)):
            out.setdefault(which, set()).add(int(index))
        return out

    base = indices(words)
    for bit in range(22):
        changed = indices(words ^ (1 << bit))
        assert all(base[i] & changed[i] for i in base)


def components_of(spark, fps):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    distinct = stored(spark.createDataFrame(signed, "fp long").distinct(), "t")
    edges = stored(simhash.links(distinct), "t")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    return {f: roots.get(f, f) for (f,) in signed}


def test_links_reach_what_brute_force_reaches(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(20):  # clouds of near fingerprints, some dense
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([2, 5, 60])):
            f = centre
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps = sorted(set(fps))
    got = components_of(spark, fps)
    want = slow_components(fps)
    keys = [got[f - (1 << 64) if f >> 63 else f] for f in fps]
    assert len(set(zip(keys, want))) == len(set(keys)) == len(set(want))


def test_every_pair_within_two_bits_meets(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 2)):
            b ^= 1 << bit
        pairs.append((a, b))
    got = components_of(spark, [x for p in pairs for x in p])
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    assert all(got[sign(a)] == got[sign(b)] for a, b in pairs)


def test_keep_first(docs, nothing):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in slow(TEXTS) if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert simhash.keep_first(nothing).collect() == []
    assert simhash.near_duplicates(nothing).collect() == []


def test_one_text_stays_where_a_doc_id_repeats(spark):
    """The least doc_id of a component has two near texts; another text of that id lies elsewhere."""
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (1, base + " "), (1, base.replace("word7 ", "Word7 ")), (2, base), (1, "quite another text here with words of its own"), (3, base + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1] and sum("another" in r.text for r in kept) == 1

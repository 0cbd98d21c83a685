import numpy as np

from ledgerloom.llm import weak_classifier as weak

from .conftest import TEXTS


def test_held_out_labels(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    scored = weak.classify(spark.read.parquet(f"{at}/documents.parquet"))
    rows = scored.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [not r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) >= 0.9


def test_trigrams_by_hand():
    v = weak.trigram_buckets(b"abcabc")
    assert abs((v**2).sum() - 1) < 1e-9 and np.count_nonzero(v) == 3
    assert not weak.trigram_buckets(b"ab").any()
    long = bytes(range(256)) * 9000
    whole = weak.trigram_buckets(long)
    assert abs((whole**2).sum() - 1) < 1e-9


def test_edges(docs, clashing, nothing):
    rows = weak.classify(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[6]) == 1
    assert len(weak.classify(clashing).collect()) == len(TEXTS)
    assert weak.classify(nothing).collect() == []


def test_scores_match_brute_force(spark, sf_dir):
    """Votes, EM document by document, and a dense scorer, all in plain Python and NumPy."""
    from .test_quality_rules import RULES_BY_HAND, slow_features, slow_posteriors

    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    hand = {k: v for k, v in RULES_BY_HAND.items() if k != "length"}
    hand["dense_symbols"] = lambda f: -1 if f["sy"] + f["sh"] >= f["n"] else int(f["sy"] + f["sh"] == 0)
    hand["long_lines"] = lambda f: -1 if f["l"] >= 5 and f["n"] < f["l"] * 2 else int(f["l"] >= 1 and f["n"] >= f["l"] * 5)
    assert [r.name for r in weak.LABELLERS] == list(hand)
    labels = np.array(slow_posteriors([[v(f) for v in hand.values()] for f in (slow_features(r.text) for r in rows)]))
    x = np.zeros((len(rows), 1 << weak.BITS))
    for i, r in enumerate(rows):
        data = (r.text or "").encode()
        for k in range(len(data) - 2):
            x[i, (int.from_bytes(data[k : k + 3], "little") * 2654435761 % (1 << 32)) >> (32 - weak.BITS)] += 1
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    w, b, dw, db = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    for _ in range(weak.STEPS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - labels
        dw = 0.9 * dw - weak.RATE * (x.T @ error / len(rows) + weak.DECAY * w)
        db = 0.9 * db - weak.RATE * error.mean()
        w, b = w + dw, b + db
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = {r.doc_id: r.score for r in weak.classify(df).collect()}
    assert max(abs(got[r.doc_id] - s) for r, s in zip(rows, want)) < 1e-4

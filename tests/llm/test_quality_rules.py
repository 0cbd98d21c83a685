import random
import re
from collections import Counter

from ledgerloom.llm import quality_rules as rules

from .conftest import TEXTS, strip


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_matches_brute_force(docs, clashing):
    want = sorted(((i, *slow_base(t)) for i, t in TEXTS), key=repr)
    assert strip(rules.judge(docs).select(*COLUMNS).collect()) == want
    assert strip(rules.judge(clashing).select(*COLUMNS).collect()) == want


def test_repeats_in_random_texts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words = words + words[: rng.randint(0, 20)]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t\n"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert strip(rules.judge(df).select(*COLUMNS).collect()) == sorted(((i, *slow_base(t)) for i, t in rows), key=repr)


def test_model_finds_who_can_be_trusted():
    rng = random.Random(2)
    truth, counts = [], Counter()
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = []
        for caught, blamed, casts in ((0.35, 0.01, 0.9), (0.3, 0.01, 0.8), (0.35, 0.02, 0.9), (0.3, 0.01, 0.7)):
            if rng.random() > casts:
                votes.append(0)
            else:
                votes.append(-1 if rng.random() < (blamed if good else caught) else 1)
        truth.append((good, tuple(votes)))
        counts[tuple(votes)] += 1
    model = rules.fit(dict(counts), 4)
    assert 0.75 < model.good < 0.95
    right = sum((model.posterior(v) >= 0.5) == good for good, v in truth) / len(truth)
    assert right > 0.9
    assert all(c > b for c, b in zip(model.caught, model.blamed))
    # The estimates are those of the draw, not of the start.
    for c, b, (caught, blamed) in zip(model.caught, model.blamed, ((0.35, 0.01), (0.3, 0.01), (0.35, 0.02), (0.3, 0.01))):
        assert abs(c - caught) < 0.12 and abs(b - blamed) < 0.03


def test_model_does_not_depend_on_the_order_of_counts():
    counts = {(1, -1): 3, (0, 1): 5, (-1, -1): 2, (1, 1): 90}
    assert rules.fit(counts, 2) == rules.fit(dict(reversed(counts.items())), 2)


def test_clean_stays_and_junk_goes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = rules.judge(docs).join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_keep_good_agrees_with_judge(docs, clashing, nothing):
    kept = {r.doc_id for r in rules.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == kept
    out = rules.keep_good(clashing)
    assert out.columns == clashing.columns and {r.doc_id for r in out.collect()} == kept
    assert rules.keep_good(nothing).collect() == [] and rules.judge(nothing).collect() == []


def sf001(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{name}.parquet")


def test_the_model_decides_and_not_a_single_vote(spark, sf_dir):
    """Verdicts differ from those of all-must-pass and of the model before its first round, and are better."""
    names = [r.name for r in rules.RULES]
    rows = rules.judge(sf001(spark, sf_dir, "documents")).join(sf001(spark, sf_dir, "labels"), "doc_id", "left").collect()
    patterns = [tuple(r[n] for n in names) for r in rows]
    counts = Counter(patterns)
    fitted, start = rules.fit(dict(counts), len(names)), rules.fit(dict(counts), len(names), 0)
    assert all(abs(r.posterior - fitted.posterior(p)) < 1e-9 for r, p in zip(rows, patterns))
    everyone = [not r.base_failed and -1 not in p for r, p in zip(rows, patterns)]
    before = [not r.base_failed and start.posterior(p) >= 0.5 for r, p in zip(rows, patterns)]
    kept = [r.kept for r in rows]
    assert sum(k != e for k, e in zip(kept, everyone)) >= 0.01 * len(rows)
    assert sum(k != b for k, b in zip(kept, before)) >= 1
    clean = [i for i, r in enumerate(rows) if r.quality == 1 and not r.base_failed]
    assert sum(kept[i] for i in clean) > sum(everyone[i] for i in clean)
    assert all(0 < x < 1 for x in (fitted.good, *fitted.caught, *fitted.blamed))
    assert len({round(x, 6) for x in fitted.caught}) == len(names)


RULES_BY_HAND = {
    "symbols": lambda f: -1 if f["sy"] * 14 >= f["c"] or f["sy"] * 10 >= f["n"] * 3 else int(f["sy"] * 50 <= f["n"]),
    "shouting": lambda f: -1 if f["sh"] * 5 >= f["n"] else int(f["sh"] * 50 <= f["n"]),
    "capitals": lambda f: -1 if f["up"] * 10 >= f["c"] * 4 else int(f["up"] * 10 <= f["c"] * 2),
    "repeated_lines": lambda f: -1 if f["dl"] >= 1 and f["dl"] * 5 >= f["l"] else int(f["dl"] == 0 and f["l"] >= 3),
    "repeated_words": lambda f: -1 if f["r"] * 10 > f["n"] else int(f["r"] == 0 and f["n"] >= 50),
    "stop_words": lambda f: -1 if f["st"] <= 1 and f["n"] >= 20 else int(f["st"] >= 5),
    "word_length": lambda f: -1 if f["c"] >= f["n"] * 7 or f["c"] * 10 <= f["n"] * 42 else int(f["n"] * 45 <= f["c"] * 10 <= f["n"] * 60),
    "variety": lambda f: -1 if f["n"] >= 20 and f["d"] <= f["n"] ** 0.88 else int(f["n"] >= 20 and f["d"] >= f["n"] ** 0.93),
    "length": lambda f: -1 if f["n"] < 40 else int(f["n"] >= 80),
}


def slow_features(text):
    import regex

    text = text or ""
    n, chars, symbols, dup, repeated, _ = slow_base(text)
    words = set(re.findall(r"[^\x20\x09-\x0D]+", text))
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    return {
        "n": n, "c": chars, "sy": symbols, "dl": dup, "r": repeated, "l": lines, "sh": text.count("!"),
        "up": len(regex.findall(r"\p{Lu}", text)), "st": len(words & set(rules.STOP_WORDS)), "d": len(words),
    }


def slow_posteriors(votes, rounds=rules.ROUNDS):
    """Expectation maximisation document by document."""
    import math

    k = len(votes[0])
    good, caught, blamed = 0.85, [0.3] * k, [0.02] * k
    for step in range(rounds + 1):
        p = []
        for v in votes:
            g, b = good, 1 - good
            for x, c, m in zip(v, caught, blamed):
                if x:
                    g, b = g * (m if x < 0 else 1 - m), b * (c if x < 0 else 1 - c)
            p.append(g / (g + b))
        if step == rounds:
            return p
        good = (math.fsum(p) + 4) / (len(p) + 5)
        for j in range(k):
            cast = [(x, v[j] < 0) for x, v in zip(p, votes) if v[j]]
            caught[j] = (math.fsum(1 - x for x, bad in cast if bad) + 1) / (math.fsum(1 - x for x, _ in cast) + 2)
            blamed[j] = (math.fsum(x for x, bad in cast if bad) + 0.1) / (math.fsum(x for x, _ in cast) + 2)


def test_verdicts_match_brute_force(spark, sf_dir, docs):
    assert [r.name for r in rules.RULES] == list(RULES_BY_HAND)
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), docs.select("doc_id", "text")):
        rows = df.collect()
        votes = [[vote(f) for vote in RULES_BY_HAND.values()] for f in (slow_features(r.text) for r in rows)]
        want = sorted(((r.doc_id, not slow_base(r.text)[-1] and p >= 0.5, round(p, 6)) for r, p in zip(rows, slow_posteriors(votes))), key=repr)
        got = [(r.doc_id, r.kept, round(r.posterior, 6)) for r in rules.judge(df).collect()]
        assert sorted(got, key=repr) == want

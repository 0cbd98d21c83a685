import random

from ledgerloom.llm import line_dedup

from .conftest import TEXTS, strip


def slow(rows):
    """Later occurrences of any three-line window lose their lines; order is doc_id, then position."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen, gone = set(), {}
    for i, t in distinct:
        lines = (t or "").split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not any(line.strip(" \t\n\x0b\x0c\r") for line in window):
                continue
            if window in seen:
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
            seen.add(window)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        cut = gone.get((i, t), set())
        text = t if not cut else "\n".join(line for k, line in enumerate(lines) if k not in cut)
        out.append((i, text, len(lines), len(cut)))
    return sorted(out, key=repr)


def run(df):
    return strip(line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect())


def test_matches_brute_force(docs, clashing, nothing):
    assert run(docs) == slow(TEXTS)
    assert run(clashing) == slow(TEXTS)
    assert run(nothing) == []


def test_random_documents(spark):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_a_document_that_repeats_itself(spark):
    text = "\n".join(["a b", "c d", "e f"] * 500)
    rows = [(1, text)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)

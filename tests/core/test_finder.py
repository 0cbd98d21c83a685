"""Pages for letters against the choice one letter after the other."""

import random
from datetime import date, timedelta

import pytest

from ledgerloom.operators import finder
from tests.core.plain_similarity import ratio, token_set

DAY = date(2009, 10, 1)
LETTERS = "case_id string, day date, names array<string>, state string, state_code string, aliases array<string>"
PAGES = "page_id string, issued date, company string"


def plain_candidates(letters, pages, days=15, least=80.0):
    out = {}
    for case, day, names, *_ in letters:
        for page, issued, company in pages:
            if None in (day, page, issued, company) or not names or abs((issued - day).days) > days:
                continue
            known = [n for n in names if n is not None]
            score = max((token_set(n, company) for n in known), default=0.0) - abs((issued - day).days)
            if score >= least:
                here = (score, max(ratio(n, company) for n in known))
                out[case, page] = max(out.get((case, page), here), here)
    return out


def sequential(letters, pages, texts):
    cands, used, chosen = plain_candidates(letters, pages), set(), {}
    for case, _, _, state, _, _ in sorted((x for x in letters if x[1]), key=lambda x: (x[1], x[0])):
        free = sorted((-s, page, r) for (c, page), (s, r) in cands.items() if c == case and page not in used)
        if not free:
            continue
        if len(free) == 1 and free[0][2] >= 90:
            pick, by_place = free[0][1], False
        else:
            pick = next((page for _, page, _ in free if state and f" {state.lower()} " in f" {(texts.get(page) or '').lower()} "), None)
            by_place = True
        if pick:
            used.add(pick)
            chosen[case] = (pick, by_place)
    return chosen


def drawn(rng, n):
    base = ["ACME MEDICAL", "ZETA LASER CENTER", "ESTAR", "NORTHERN EYE CLINIC", "LASIK CLINIC", "BIO TESTING", "MEDTRONICS"]
    edits = lambda s: "".join(c for c in s if rng.random() > 0.04)
    states = ["Ohio", "Texas", None]
    letters = [(f"c{i}", DAY + timedelta(rng.randint(0, 60)) if rng.random() < 0.95 else None, [edits(rng.choice(base)), rng.choice([None, "", rng.choice(base)])], rng.choice(states), None, None) for i in range(n)]
    pages = [(f"ucm{rng.randint(0, n)}", DAY + timedelta(rng.randint(-5, 65)), edits(" ".join(rng.sample((rng.choice(base) + rng.choice(["", " INC", " OF OHIO"])).split(), k=1) if rng.random() < 0.1 else [rng.choice(base)]))) for _ in range(2 * n)]
    pages += [(None, DAY, "ACME MEDICAL"), ("ucm0", None, "ACME MEDICAL"), ("ucm0", DAY, None), ("ucm0", DAY, ""), pages[0]]
    texts = {p: rng.choice(["in Ohio and elsewhere", "a Texas firm", "nowhere", None]) for p, *_ in pages if p and rng.random() < 0.9}
    return letters + [("none", DAY, None, "Ohio", None, None), ("empty", DAY, [], "Ohio", None, None)], pages, texts


@pytest.mark.parametrize("seed, n", [(0, 40), (1, 12), (2, 60)])
def test_pages_equal_the_sequential_choice(spark, seed, n):
    letters, pages, texts = drawn(random.Random(seed), n)
    l, p = spark.createDataFrame(letters, LETTERS), spark.createDataFrame(pages, PAGES)
    got = {(r.case_id, r.page_id): (r.score, r.name_ratio) for r in finder.page_candidates(l, p).collect()}
    assert got == plain_candidates(letters, pages)
    found = finder.find_pages(l, p, spark.createDataFrame(list(texts.items()), "page_id string, text string")).collect()
    chosen = {r.case_id: (r.page_id, r.by_place) for r in found}
    assert len(found) == len(chosen) and chosen == sequential(letters, pages, texts)
    if seed == 0:
        assert {b for _, b in chosen.values()} == {True, False}


def test_nothing_to_find(spark):
    l, p, t = spark.createDataFrame([], LETTERS), spark.createDataFrame([], PAGES), spark.createDataFrame([], "page_id string, text string")
    assert finder.find_pages(l, p, t).collect() == []


def test_names_meet_by_few_keys(spark):
    """Names of sixteen random letters meet by long pieces, so that chance pairs are few: 3 keys a left name, 4 a right one."""
    from ledgerloom.operators import linkage

    l, p = (spark.createDataFrame([(f"{rng.getrandbits(32):08X} {rng.getrandbits(32):08X}",) for _ in range(50)], f"{c} string") for c, rng in (("a", random.Random(1)), ("b", random.Random(2))))
    pairs = linkage.similar_names(l, p, "a", "b", 90.0)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan()
    made = sorted(int(x) for x in __import__("re").findall(r"Generate_rows=(\d+)", _generated(plan)))
    assert made == [150, 200]


def _generated(plan) -> str:
    """Rows that each Generate of a plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _generated(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _generated(plan.plan())
    own = f"Generate_rows={plan.metrics().apply('numOutputRows').value()} " if name == "Generate" else ""
    children = plan.children()
    return own + "".join(_generated(children.apply(i)) for i in range(children.size()))

import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks, linkage, listing, panel, ranking, temporal

D0 = date(2020, 1, 1)
day = lambda n: D0 + timedelta(days=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def asof_frames(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice("abc"), day(rng.randint(0, 100))) for i in range(150)]
    right = [(i, rng.choice("abc"), day(rng.randint(0, 100))) for i in range(60)]
    return left, right, spark.createDataFrame(left, "id int, k string, d date"), spark.createDataFrame(right, "rid int, k string, rd date")


def test_asof_backward_is_that_of_pandas(spark):
    left, right, l, r = asof_frames(spark, 1)
    got = {x.id: x.rid for x in temporal.asof_backward(l, r, ["k"], "d", "rd", ["rid"], tolerance_days=10, ties=("rid",)).collect()}
    a = pd.DataFrame(left, columns=["id", "k", "d"]).assign(d=lambda x: pd.to_datetime(x.d)).sort_values("d", kind="stable")
    b = pd.DataFrame(right, columns=["rid", "k", "rd"]).assign(rd=lambda x: pd.to_datetime(x.rd)).sort_values(["rd", "rid"], kind="stable")
    m = pd.merge_asof(a, b, left_on="d", right_on="rd", by="k", allow_exact_matches=False, tolerance=pd.Timedelta(days=10))
    assert got == {int(i): None if pd.isna(x) else int(x) for i, x in zip(m.id, m.rid)}


def test_asof_forward_is_that_of_pandas(spark):
    left, right, l, r = asof_frames(spark, 2)
    got = {x.id: x.rid for x in temporal.asof_forward(l, r, ["k"], "d", "rd", ["rid"], ties=("rid",)).collect()}
    a = pd.DataFrame(left, columns=["id", "k", "d"]).assign(d=lambda x: pd.to_datetime(x.d)).sort_values("d", kind="stable")
    b = pd.DataFrame(right, columns=["rid", "k", "rd"]).assign(rd=lambda x: pd.to_datetime(x.rd)).sort_values(["rd", "rid"], kind="stable")
    m = pd.merge_asof(a, b, left_on="d", right_on="rd", by="k", direction="forward")
    assert got == {int(i): None if pd.isna(x) else int(x) for i, x in zip(m.id, m.rid)}


def test_tolerance_and_equal_dates(spark):
    r = spark.createDataFrame([("a", day(0), 1)], "k string, rd date, v int")
    l = spark.createDataFrame([(1, "a", day(0)), (2, "a", day(547)), (3, "a", day(548)), (4, "a", None)], "id int, k string, d date")
    got = dict(rows(temporal.asof_backward(l, r, ["k"], "d", "rd", ["v"], tolerance_days=547).select("id", "v")))
    assert got == {1: None, 2: 1, 3: None, 4: None}


def test_period_bounds(spark):
    p = spark.createDataFrame([("a", day(0), day(90), "p1"), ("a", day(95), day(180), "p2")], "k string, period_start date, period_end date, p string")
    e = spark.createDataFrame([(1, "a", day(90)), (2, "a", day(0)), (3, "a", day(1)), (4, "a", day(93)), (5, "a", day(200)), (6, "a", None)], "id int, k string, d date")
    assert dict(rows(temporal.assign_to_period(e, p, ["k"], "d", ["p"]).select("id", "p"))) == {1: "p1", 2: None, 3: "p1", 4: None, 5: None, 6: None}


def test_two_routes_and_eras(spark):
    by_id = temporal.era_list(spark.createDataFrame([("1", "X", 2000, 2005)], "fei string, g string, valid_from int, valid_to int"), "fei", "g")
    by_name = temporal.era_list(spark.createDataFrame([("N", "Y", 1990, 2020), ("M", "Z", 1990, 1999), ("M", "W", 2000, 2009)], "name string, g string, valid_from int, valid_to int"), "name", "g")
    data = [(1, "1", "N", 2003), (2, "1", "N", 2010), (3, "9", "N", 2010), (4, None, "M", 2001), (5, None, "M", None), (6, "1", None, None)]
    out = temporal.two_route_link(spark.createDataFrame(data, "id int, fei string, name string, year int"), by_id, by_name, "fei", "name", "year")
    got = {r.id: (r.link_key, r.link_source) for r in out.collect()}
    assert got == {1: ("X", "fei_exact"), 2: (None, None), 3: ("Y", "name_normalized"), 4: ("W", "name_normalized"), 5: (None, None), 6: ("X", "fei_exact")}


def test_conflicts_by_brute_force(spark):
    rng = random.Random(5)
    data = []
    for n in range(200):
        for _ in range(rng.randint(1, 4)):
            low = rng.randint(1990, 2010)
            data.append((str(n), rng.choice("xyz"), low, low + rng.randint(0, 6)))
    df = spark.createDataFrame(data, "name string, g string, valid_from int, valid_to int")
    got = {r.name for r in temporal.conflicting_keys(df, "name", "g").collect()}
    want = {a[0] for a in data for b in data if a[0] == b[0] and a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert got == want


def test_period_starts(spark):
    df = spark.createDataFrame([("a", day(0)), ("a", day(120)), ("a", day(241)), ("b", day(5))], "k string, e date")
    got = {(r.k, r.e): r.period_start for r in temporal.period_starts(df, ["k"], "e", [], 120, 3).collect()}
    assert got["a", day(120)] == day(0) and got["a", day(241)] == date(2020, 5, 29) and got["b", day(5)] == date(2019, 10, 6)


def test_lookup_refuses_ambiguity(spark):
    c = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1), ("B", 2)], "name string, key int")
    assert rows(linkage.unique_lookup(c, "name", "key")) == [("A", 1, 1), ("B", 2, None)]


def test_prefixes(spark):
    names = spark.createDataFrame([("ACME DEVICES EAST",), ("ACME",), ("ACMEX DEVICES",), ("AB CD EF",), (None,)], "name string")
    index = spark.createDataFrame([("ACME", 1), ("ACME DEVICES", 2), ("AB CD", 3), ("ACME DEVICES EAST", 4)], "name string, key int")
    got = {r.name: r.key for r in linkage.longest_prefix(names, index, "name", "key", least_chars=8, least_tokens=2).collect()}
    assert got == {"ACME DEVICES EAST": 2, "ACME": None, "ACMEX DEVICES": None, "AB CD EF": None, None: None}
    assert {r.name: r.key for r in linkage.longest_prefix(names, index, "name", "key", least_chars=4).collect()}["ACME DEVICES EAST"] == 2


def test_backfill(spark):
    exact = spark.createDataFrame([("A", "1"), ("B", "2")], "name_key string, gvkey string")
    curated = spark.createDataFrame([("B", "3", 1990, 2000, "ct_override_windowed"), ("C", "UNMAPPED", 1900, 2099, "ct_override")], "name_key string, gvkey string, valid_from int, valid_to int, match_source string")
    recipients = spark.createDataFrame([("A",), ("B",), ("C",), ("BIG PARENT EAST",)], "name_key string")
    parents = spark.createDataFrame([("BIG PARENT", "9")], "name_key string, gvkey string")
    out = linkage.backfill(exact, curated, recipients, parents)
    got = {r.name_key: (r.gvkey, r.match_source, r.match_status) for r in out.collect()}
    assert got == {
        "A": ("1", "exact_normalized", "matched"), "B": ("3", "ct_override_windowed", "matched"), "C": (None, "ct_override", "resolved_unlisted_parent"),
        "BIG PARENT EAST": ("9", "parent_prefix", "matched"),
    }


def test_fuzzy_is_the_best_over_all_names(spark):
    from tests.core.plain_similarity import token_sort

    rng = random.Random(5)
    base = ["MEDTRONICS", "BIOSCIENCES", "MEDTRONIC SOFAMOR", "GREEN PLANET", "ESTAR TECHNOLOGIES", "ABBOTT POINT OF CARE", "X", "", "AÉRO\u00a0NAUTIQUE\tSA"]
    a = base + ["".join(rng.choice("ABC ") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    b = ["MDTRONICS", "BOSCIENCES", "MDTRONIC SOFAMORE"]
    for name in base[:6]:
        # An error at every position: a letter dropped, added, or changed.
        b += [name[:i] + x + name[j:] for i in range(len(name)) for x, j in (("", i + 1), ("Q", i), ("Q", i + 1))]
    for name in a[7:]:
        for _ in range(8):
            w = list(name)
            for _ in range(rng.randint(0, 4)):
                w.insert(rng.randint(0, len(w)), rng.choice("ABCQ ")) if rng.random() < 0.5 or not w else w.pop(rng.randrange(len(w)))
            b.append("".join(w))
    left, right = (spark.createDataFrame([(x,) for x in [*xs, None]], f"{n} string") for xs, n in ((a, "a"), (b, "b")))
    for cutoff in (90.0, 81.5, 60.0):
        want = {}
        for x in set(a):
            scores = [(-token_sort(x, y), y) for y in set(b)]
            if -min(scores)[0] >= cutoff:
                want[x] = min(scores)[1]
        assert {r.a: r.b for r in linkage.fuzzy_top1(left, right, "a", "b", cutoff).collect()} == want
    # One by one, so that no better name hides a loss.
    for x, y in (("MEDTRONICS", "MDTRONICS"), ("BIOSCIENCES", "BOSCIENCES"), ("MEDTRONIC SOFAMOR", "MDTRONIC SOFAMORE")):
        assert linkage.fuzzy_top1(left.filter(left.a == x), right.filter(right.b == y), "a", "b").count() == 1


def test_fuzzy_loses_no_match(spark):
    from tests.core.plain_similarity import token_sort

    rng = random.Random(8)
    words = ["ACME", "ZETA", "MEDIC", "DEVICE", "EAST", "WEST", "NORTHERN"]
    a = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)})
    b = sorted({w[:3] + w[4:] if rng.random() < 0.5 else w for w in a})
    got = {r.a for r in linkage.fuzzy_top1(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b").collect()}
    want = {x for x in a if max(token_sort(x, y) for y in b) >= 90}
    assert got == want


def test_keys_by_like(spark):
    keys = spark.createDataFrame([("1", "ACME"), ("7", "ZETA")], "cik string, probe string")
    master = spark.createDataFrame([("1", "Acme Inc"), ("2", "The Zeta Co")], "cik string, conm string")
    assert rows(linkage.keys_by_like(keys, master, "cik", "conm", "probe")) == [("1", "ACME", "Acme Inc"), ("2", "ZETA", "The Zeta Co")]


def test_null_keys_are_no_panel_rows(spark):
    e = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "id int, k string")
    assert rows(panel.event_panel(e, ["k"], "id", {"n": F.lit(True)})) == [("a", 1, 2)]
    s = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    assert rows(panel.counts_by_key(s, ["k"], {"v": "n"})) == [("a", 0), ("b", 2)]


def test_active_years(spark):
    f = spark.createDataFrame([("1", date(2020, 6, 30), None, 1.0, 2.0), ("1", date(2021, 6, 30), 2021, None, 2.0)], "gvkey string, datadate date, fyear int, prcc_f double, csho double")
    assert rows(panel.active_years(f)) == [("1", 2020)]


def test_dense_rank_and_choice(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "id int, v int")
    assert dict(rows(ranking.dense_rank_of(df, "v").select("id", "rank"))) == {1: 2, 2: 1, 3: 1, 4: 0}
    c = spark.createDataFrame(
        [(1, "a", True, 5, 90.0, False), (1, "b", True, 3, 80.0, False), (1, "c", False, 0, None, True), (2, "d", False, None, None, True), (2, "e", False, None, 99.0, True)],
        "case int, url string, printed boolean, gap int, score double, live boolean",
    )
    got = {r.case: (r.url, r.n_acceptable) for r in ranking.choose_one(c, "case", "printed", "gap", "score", "live", "url").collect()}
    assert got == {1: ("b", 3), 2: ("d", 2)}


def test_greedy_assignment(spark):
    pairs = spark.createDataFrame([("g", "x", "1", 1, 90.0), ("g", "x", "2", 1, 95.0), ("g", "y", "2", 2, 99.0), ("g", "y", "1", 2, 10.0)], "g string, l string, r string, o int, s double")
    assert rows(ranking.greedy_assignment(pairs, "g", "l", "r", "o", "s")) == [("g", "x", "2", 95.0), ("g", "y", "1", 10.0)]
    assert rows(ranking.greedy_assignment(pairs.limit(0), "g", "l", "r", "o", "s")) == []


def test_greedy_assignment_is_the_sequential_choice(spark):
    import random

    schema = "g int, l int, r int, o int, s double"
    for seed in range(4):
        rng = random.Random(seed)
        # Few scores and orders, so that ties decide; group 0 has most of the pairs, the last one equal wishes of all.
        pairs = {(rng.choice([0, 0, 0, 1, 2]), rng.randrange(30), rng.randrange(25)) for _ in range(250)} | {(3, a, b) for a in range(6) for b in range(5)}
        order = {(g, a): rng.randrange(4) for g, a, _ in pairs}
        data = [(g, a, b, order[g, a], None if rng.random() < 0.1 else float(b if g == 3 else rng.randrange(4))) for g, a, b in sorted(pairs)]
        want, taken = [], set()
        for g, a in sorted(order, key=lambda k: (order[k], k[1])):
            free = [x for x in data if x[:2] == (g, a) and (g, x[2]) not in taken]
            if free:
                best = min(free, key=lambda x: (x[4] is None, -(x[4] or 0), x[2]))
                taken.add((g, best[2]))
                want.append((g, a, best[2], best[4]))
        given = data + data[:20] + [(None, 1, 1, 1, 1.0), (1, None, 1, 1, 1.0), (1, 1, None, 1, 1.0), (1, 99, 1, None, 9.0)]
        got = ranking.greedy_assignment(spark.createDataFrame(given, schema), "g", "l", "r", "o", "s")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def slow_bounds(targets, known, bands=(3, 7, 15, 30), least=8):
    import numpy as np

    out = []
    for i, d in targets:
        found = (i, None, None, None)
        for b in bands:
            near = [v for k, v in known if d is not None and k is not None and v is not None and abs((k - d).days) <= b]
            if len(near) >= least:
                found = (i, b, round(float(np.percentile(near, 5)), 6), round(float(np.percentile(near, 95)), 6))
                break
        out.append(found)
    return sorted(out, key=repr)


def test_neighbour_bounds_by_definition(spark):
    import random

    rng = random.Random(8)
    day = lambda: date(2020, 1, 1) + timedelta(days=int(rng.triangular(0, 200, 30)))
    known = [(day(), rng.choice([1.0, 2.0, 2.0, round(rng.gauss(0, 9), 3)])) for _ in range(600)] + [(None, 1.0), (day(), None)]
    known += [(date(2020, 2, 1), 7.0)] * 400  # one value on one day
    targets = [(i, day()) for i in range(60)] + [(100, None), (101, date(2021, 1, 1)), (102, date(2020, 2, 1)), (102, date(2020, 2, 1))]

    def run(t, k):
        a, b = spark.createDataFrame(t, "id int, day date"), spark.createDataFrame(k, "day date, v double")
        return sorted(((r.id, r.band, *(None if x is None else round(x, 6) for x in (r.low, r.high))) for r in ranking.neighbour_bounds(a, b, "id", "day", "v").collect()), key=repr)

    assert run(targets, known) == slow_bounds(targets, known)
    assert run(targets[:3], []) == [(i, None, None, None) for i in range(3)]
    assert run([], known) == []


def joined_rows(df):
    """Rows that the joins of a plan gave when it ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_neighbour_bounds_meet_no_pairs(spark):
    """A hundred targets and a hundred known rows on each of sixty days: rows that meet stay in proportion to the known ones."""
    n, day = 6000, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 60).cast("int"))
    known = spark.range(n).select(day.alias("day"), F.col("id").cast("double").alias("v"))
    met = joined_rows(ranking.neighbour_bounds(spark.range(n).select("id", day.alias("day")), known, "id", "day", "v"))
    assert 0 < met < 10 * n < n * n / 60 * 7


def test_review_flags(spark):
    df = spark.createDataFrame([(9, True), (1, False)], "gap int, shared boolean")
    flags = ranking.review_flags([("date gap", F.col("gap") > 7), ("shared page", F.col("shared"))])
    assert [r.x for r in df.select(flags.alias("x")).collect()] == ["date gap; shared page", None]


def test_listing_rules(spark):
    d = lambda s: date.fromisoformat(s)
    schema = "id int, ev array<struct<t:date,form:string>>, periodic array<date>, windows array<struct<start:date,end:date,exchange:string>>, auto boolean, ex array<string>"
    old, reports = (d("1996-01-01"), "10-K"), [d("2019-12-01")]
    data = [
        (1, [], [], [], True, []),
        (2, [], reports, [(d("2018-01-01"), d("2020-06-01"), "NYSE")], False, []),
        (3, [], reports, [(d("2018-01-01"), d("2020-05-31"), "NYSE")], False, []),
        (4, [(d("2015-01-01"), "8-A12B")], reports, [], True, []),
        # A delisting of a firm that does not go on reporting is its end; one that goes on has moved.
        (5, [(d("2015-01-01"), "8-A12B"), (d("2019-11-20"), "25")], reports, [], True, []),
        (6, [], [d("2018-01-01")], [], False, []),
        (7, [(d("2019-11-10"), "15-12B")], [d("2019-11-20")], [], False, []),
        (8, [], [d("2021-01-01")], [], False, []),
        (9, [(d("2019-10-01"), "S-1")], [d("2021-01-01")], [(d("2019-10-15"), None, "NYSE")], False, []),
        (10, [(d("2015-01-01"), "8-A12B"), (d("2017-11-20"), "25")], [d("2019-12-01")], [], True, []),
        # Never registered before the day: a later delisting tells of an old issuer only.
        (11, [old, (d("2021-03-01"), "25")], reports, [], True, []),
        (12, [(d("2010-01-01"), "10-K"), (d("2021-03-01"), "25")], reports, [], True, []),
        (13, [(d("2010-01-01"), "10-K"), (d("2005-02-01"), "8-A12G"), (d("2021-03-01"), "25")], reports, [], True, []),
        (14, [old, (d("2020-07-01"), "8-A12B"), (d("2021-03-01"), "25")], reports, [], True, []),
        (15, [old], reports, [], True, []),
        # Listed today: all along if older than the records, but for the time between two listings.
        (16, [old], reports, [], True, ["NYSE"]),
        (17, [(d("2010-01-01"), "10-K")], reports, [], True, ["NYSE"]),
        (18, [(d("2010-01-01"), "8-A12B"), (d("2018-01-01"), "25"), (d("2020-08-01"), "8-A12B")], reports, [], True, ["Nasdaq"]),
        (19, [(d("2010-01-01"), "8-A12B"), (d("2020-05-01"), "25"), (d("2020-08-01"), "8-A12B")], reports, [], True, ["Nasdaq"]),
        (20, [(d("2010-01-01"), "8-A12B")], reports, [], True, ["OTC"]),
        (21, [(d("2010-01-01"), "8-A12B")], reports, [], False, []),
    ]
    df = spark.createDataFrame(data, schema)
    day = F.lit("2020-05-31").cast("date")
    v = listing.listing_verdict(F.lit(True), F.col("ev"), F.col("periodic"), F.col("windows"), F.col("auto"), F.col("ex"), day)
    got = {r.id: r.v for r in df.select("id", v.alias("v")).collect()}
    yes = {2, 4, 5, 9, 11, 13, 16, 19, 20}
    assert {i: r.status for i, r in got.items()} == {i: "YES" if i in yes else "NO" if i in (1, 6, 7, 8) else "OTC" for i in got}
    assert got[2].evidence == "SEC-reporting at letter date (last periodic report 2019-12-01); stock listed on NYSE" and got[2].exchange == "NYSE"
    assert got[7].evidence == "no longer public: deregistered (Form 15) 2019-11-10"
    assert got[8].evidence == "not yet public: first periodic report 2021-01-01"
    assert got[9].evidence.startswith("SEC-reporting at letter date (IPO registration within the prior 15 months)")
    assert got[11].exchange == "US exchange (not identified)" and got[16].exchange == "NYSE"
    label = lambda s, p: spark.range(1).select(listing.status_label(F.lit(s), F.lit(p)).alias("x")).first().x
    assert [label("YES", False), label("YES", True), label("OTC", True), label("UNCLEAR", False)] == ["Yes", "Yes - via parent", "No", "Unclear"]
    years = listing.universe_by_year(
        df.filter("id = 2"), "id", F.lit("2019-01-01").cast("date"), F.lit("2021-12-31").cast("date"),
        lambda x: listing.listing_status(F.lit(True), F.col("ev"), F.col("periodic"), F.col("windows"), F.col("auto"), F.col("ex"), x),
    )
    assert rows(years) == [(2, 2019), (2, 2020)]


def test_asof_with_a_hot_key_and_far_hits(spark):
    """Hits lie months away, on the same day, or nowhere; one key has most of the rows."""
    import random

    rng = random.Random(3)
    day = lambda: date(2015 + rng.randint(0, 4), rng.randint(1, 12), rng.randint(1, 28))
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([day()] * 9 + [None])) for i in range(400)]
    right = [(rng.choice(["hot"] * 3 + ["a", None]), day(), 1000 + j) for j in range(60)]
    a = spark.createDataFrame(left, "id int, k string, d date")
    b = spark.createDataFrame(right, "k string, at date, v int")
    back = {r.id: r.v for r in temporal.asof_backward(a, b, ["k"], "d", "at", ["v"], ties=("v",)).collect()}
    ahead = {r.id: r.v for r in temporal.asof_forward(a, b, ["k"], "d", "at", ["v"], ties=("v",)).collect()}
    assert len(back) == len(ahead) == len(left)
    for i, k, d in left:
        own = [(at, v) for rk, at, v in right if rk == k and d is not None]
        assert back[i] == max([x for x in own if x[0] < d], default=(None, None))[1]
        assert ahead[i] == min([x for x in own if x[0] >= d], default=(None, None))[1]


def test_half_open_pick_keeps_equal_rows(spark):
    a = spark.createDataFrame([(1, "x", date(2020, 1, 5)), (2, "x", date(2020, 1, 5)), (3, "y", date(2020, 1, 5))], "id int, k string, d date").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    w = spark.createDataFrame([("x", date(2020, 1, 1), None, 2, "B"), ("x", date(2020, 1, 5), date(2020, 1, 6), 1, "A")], "k string, s date, e date, pos int, v string")
    out = temporal.half_open_pick(a, w, "k", "d", "s", "e", "pos", ["v"], "id")
    assert out.columns == [*a.columns, "v"] and sorted((r.id, r.v) for r in out.collect()) == [(1, "A"), (2, "A"), (3, None)]


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(checks.CheckFailed):
        checks.unique(df, ["a"])
    with pytest.raises(checks.CheckFailed):
        checks.one_to_one(df, df, ["a"])
    with pytest.raises(checks.CheckFailed):
        checks.conserved(df, df.filter("b > 2"), "b")
    with pytest.raises(checks.CheckFailed):
        checks.ordered(df, "b", "a")
    with pytest.raises(checks.CheckFailed):
        checks.at_least(df, 3)
    with pytest.raises(checks.CheckFailed):
        checks.domain(df, "a", [2])
    assert checks.reconcile(df, df, ["b"], ["a"]).count() == 0
    assert checks.unique(df, ["b"]) is df

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mtree
from ledgerloom.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, top=5, each=50):
    """Every query against all rows."""
    kept = set()
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, tuple(math.floor(256 * x) for x in v)))
    size = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + (0,) * (size - len(v))) for i, v in kept]
    out = []
    for i, q in kept:
        if i % each == 0:
            found = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i})
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:top])]
    return sorted(out)


def run(df, **how):
    return sorted(tuple(r) for r in mtree.top_products(df, **how).select("query_id", "rank", "vec_id", "score").collect())


def cloud(n, size, groups, spread, seed):
    """Vectors about a few centres, rounded so that they hold as floats."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    for i in range(n):
        c = centres[i % groups]
        yield i, [round((x + draw.gauss(0, spread)) * 1024) / 1024 for x in c], i % 3


@pytest.mark.parametrize(("groups", "spread"), [(6, 0.05), (1, 1.0)])
def test_matches_brute_force(spark, monkeypatch, groups, spread):
    monkeypatch.setattr(mtree, "LEAF_ROWS", 40)
    monkeypatch.setattr(mtree, "PAGE_ROWS", 16)
    monkeypatch.setattr(mtree, "TILE_NUMBERS", 6 * 64)
    monkeypatch.setattr(mtree, "TILE_QUERIES", 5)
    rows = list(cloud(900, 6, groups, spread, 1))
    assert run(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_ties_copies_and_odd_rows(spark):
    same = [0.25, -0.5, 0.75]
    rows = [(i, same, None) for i in range(-60, 140)]  # one vector with most of the rows
    rows += [(150, None, 1), (151, [0.1, None, 0.2], 1), (152, [math.nan, 0.0, 1.0], 1), (153, [math.inf, 0.0, 1.0], 1), (None, same, 1)]
    rows += [(200, [0.5], 1), (200, [0.5], 1), (201, [], 1), (250, [0.0, 0.0, 0.0], 2), (300, same, 1), (300, [1.0, 1.0, 1.0], 1), (301, [2.0, -3.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "ids", "leaf", "page", "q", "score", "rank", "a.b")})
    assert run(df.repartition(4)) == slow(rows)
    assert run(df, top=2, each=7) == slow(rows, 2, 7)


def test_few_and_none(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(0, None, 1)], SCHEMA)) == []
    assert run(spark.createDataFrame([(0, [0.5], 1)], SCHEMA)) == []
    rows = [(0, [0.5, 0.5], 1), (3, [0.5, -0.5], 1), (50, [-0.5, 0.5], 1)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)], SCHEMA))


def test_bounds_leave_out_most_of_a_clustered_table(spark, monkeypatch):
    """With bounds of a query's own cluster, the tree reaches few of the leaves of the others."""
    monkeypatch.setattr(mtree, "LEAF_ROWS", 20)
    rows = spark.createDataFrame(list(cloud(1000, 8, 10, 0.01, 2)), SCHEMA)
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    entries = stored(mtree.entries_of(whole, 5), "t")
    squared = max(sum(x * x for x in r["v"]) for r in entries.collect())
    tree, paged, pages = mtree.build(entries, 8, squared, entries.count())
    assert len(tree.routes) > 20 and tree.rows.sum() == entries.count()
    asked = whole.filter("vec_id < 40").select(F.col("vec_id").alias("q"), "v", F.lit(60.0).alias("bound"))
    reached = mtree.reachable(asked, tree).groupBy("q").count().agg(F.avg("count")).first()[0]
    assert reached < len(tree.routes) / 3
    # What pages and radii say holds for every entry.
    both = paged.join(pages, ["leaf", "page"])
    assert both.filter("far < low OR far > high").count() == 0

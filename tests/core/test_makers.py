"""Makers of reports are resolved in one reading of the reports, to the same links."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import linkage
from ledgerloom.plans import report_queries

WORDS = ("ACME", "BIO", "CARE", "DELTA", "EAST", "LAB")


def test_names_read_once_link_as_names_joined_back(spark):
    rng = random.Random(4)
    name = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))
    rows = spark.createDataFrame([(i, name(5), f"x{i}") for i in range(300)] + [(300, None, "x"), (301, "", "y")], "id int, name string, more string")
    index = spark.createDataFrame([(name(3), rng.choice((1, 2, 3, None))) for _ in range(60)] + [(None, 9)], "name string, key int")
    for least_chars, least_tokens, strict in ((6, 1, True), (1, 1, False), (9, 2, True)):
        usual = linkage.longest_prefix(rows, index, "name", "key", least_chars, least_tokens, strict)
        once = linkage.longest_prefix(rows, index, "name", "key", least_chars, least_tokens, strict, row_id="id")
        assert sorted(once.columns) == sorted(usual.columns)
        got, want = ({tuple(r) for r in df.select(*usual.columns).collect()} for df in (once, usual))
        assert got == want and len(want) == 302
        assert usual.filter(F.col("key").isNotNull()).count() > 20


def test_reports_are_taken_apart_twice_at_most(spark, sf_dir):
    """Once to know the makers and once to place them; names are made of distinct makers."""
    plan = report_queries.adverse_reports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    assert sum("Generate posexplode" in line for line in lines) == 2
    named = [i for i, line in enumerate(lines) if "INCORPORATED" in line]
    assert named
    for i in named:
        below = [line for line in lines[i + 1 :][: next((n for n, x in enumerate(lines[i + 1 :]) if depth(x) <= depth(lines[i])), None)]]
        first = next(n for n, line in enumerate(below) if "Generate posexplode" in line)
        assert any("Aggregate" in line for line in below[:first])

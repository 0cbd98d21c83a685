"""What the as-of joins sort and carry: no aggregation of all rows by month, each value once, the left side's own types."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import temporal
from ledgerloom.plans import temporal_queries

D0 = date(2020, 1, 1)


@pytest.mark.parametrize("join", (temporal.asof_forward, temporal.asof_backward))
def test_plans(spark, join):
    l = spark.range(3).select(F.col("id").alias("k"), F.lit(D0).alias("d"))
    r = spark.range(3).select(F.col("id").alias("k"), F.lit(D0).alias("rd"), "id")
    plan = join(l, r, ["k"], "d", "rd", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_periods_are_not_given_counts_by_day(spark, sf_dir):
    plan = temporal_queries.period_assign(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "l_shipdate" in line or "Aggregate [" in line and "day#" in line]


@pytest.mark.parametrize("forward", (True, False))
@pytest.mark.parametrize("right_time", ("date", "timestamp"))
def test_rows_and_types_stay(spark, forward, right_time):
    """Keys that may be NULL, rows without a time, other columns, keys and times of unlike types; against a plain loop."""
    rng = random.Random(5)
    at = lambda n: D0 + timedelta(n)
    left = [(i, rng.choice((1, 1, 1, 2, None)), at(rng.randint(0, 900)) if rng.random() < 0.9 else None, [i]) for i in range(120)]
    right = [(i, rng.choice((1, 2, 3, None)), at(rng.randint(0, 900)) if rng.random() < 0.9 else None) for i in range(40)]
    wide = [(i, k, d if d is None or right_time == "date" else datetime(d.year, d.month, d.day)) for i, k, d in right]
    l = spark.createDataFrame(left, "id int, k int, d date, more array<int>")
    r = spark.createDataFrame(wide, f"rid int, k bigint, rd {right_time}")
    join = temporal.asof_forward if forward else temporal.asof_backward
    out = join(l, r, ["k"], "d", "rd", ["rid"], ties=("rid",))
    assert out.select(*l.columns).dtypes == l.dtypes
    want = set()
    for i, k, d, more in left:
        fits = [(rd, rid) for rid, rk, rd in right if rk == k and None not in (d, rd) and (rd >= d if forward else rd < d)]
        want.add((i, k, d, tuple(more), (min(fits) if forward else max(fits))[1] if fits else None))
    assert {(x.id, x.k, x.d, tuple(x.more), x.rid) for x in out.collect()} == want

"""Several kinds of windows found in one sweep, and how little a combined filing shuffles."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import temporal
from ledgerloom.plans import composites as c

from .test_composites import _branches

D0 = date(2020, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_meet_filings_once(spark):
    """One join with the filings and one window for all branches, and not a join and an as-of join for each."""
    plan = _plan(c.combine(*_branches(spark)))
    assert (plan.count("Join "), plan.count("Window [")) == (1, 1)


def test_combined_query_sorts_events_once(spark, sf_dir):
    from ledgerloom.plans import filing_queries

    plan = _plan(filing_queries.combined_filings(spark, sf_dir))
    assert (plan.count("Join "), plan.count("Window [")) == (4, 1)  # lines of three types meet their orders


def test_cycles_come_without_a_join(spark):
    filings = spark.createDataFrame([("1", D0, D0)], "gvkey string, filing_date date, report_date date")
    assert "Join" not in _plan(temporal.reporting_periods(filings))


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_one_kind_at_a_time(spark, seed):
    rng = random.Random(seed)
    at = lambda: D0 + timedelta(rng.randint(0, 60)) if rng.random() < 0.9 else None
    key = lambda: rng.choice(("a", "a", "b", None))
    events = spark.createDataFrame([(i, key(), at()) for i in range(80)], "id int, k string, d date")
    # Ends and starts that are equal or missing, and windows over each other.
    kind = lambda name, n: spark.createDataFrame([(key(), at(), at(), i) for i in range(n)], f"k string, start date, end date, {name} int").dropDuplicates(["k", "start", "end"])
    windows = {"short": kind("s", 25).localCheckpoint(), "long": kind("l", 8).localCheckpoint()}
    got = {x.id: x for x in temporal.assign_in_one_sweep(events, ["k"], "d", windows).collect()}
    assert len(got) == 80 and {(x.id, x.k, x.d) for x in got.values()} == {tuple(x) for x in events.collect()}
    first = lambda w: (w.start is not None, w.start or D0)
    for name, of in windows.items():
        rows = of.collect()
        assert {(x.id, x[name[0]]) for x in temporal.assign_to_period(events, of, ["k"], "d", [name[0]], "start", "end").collect()} == {
            (i, x[name] and x[name][0]) for i, x in got.items()
        }
        for x in got.values():
            ends = [w for w in rows if w.k == x.k and w.end is not None and x.d is not None and w.end >= x.d]
            w = min(ends, key=lambda w: (w.end, first(w)), default=None)
            assert (x[name] and x[name][0]) == (w[3] if w and w.start is not None and w.start < x.d else None)


def test_fiscal_starts_and_cycles(spark):
    rng = random.Random(7)
    rows = set()
    while len(rows) < 120:
        end = D0 + timedelta(rng.randint(0, 1500))
        rows.add((rng.choice(("a", "b", None)), end if rng.random() < 0.7 else None, end + timedelta(rng.randint(0, 60)), rng.choice(("10-K", "10-Q"))))
    rows = [(i, *r) for i, r in enumerate(sorted(rows, key=str))]
    filings = spark.createDataFrame(rows, "id int, gvkey string, report_date date, filing_date date, form string")
    out = temporal.reporting_periods(filings).localCheckpoint()
    # The least of the most frequent months mod 3, as by an aggregation; none for filings without a firm.
    imputed = out.filter("period_end_imputed").select("id", "gvkey", "filing_date", "period_end")
    ends = out.filter("NOT period_end_imputed AND gvkey IS NOT NULL")
    from ledgerloom.functions.dates import cycle_month_end, nearest_month_end

    cycles = ends.groupBy("gvkey").agg(F.mode(F.month(nearest_month_end(F.col("period_end"))) % 3, deterministic=True).alias("m"))
    want = imputed.join(cycles, "gvkey", "left").withColumn("want", cycle_month_end(F.col("filing_date"), F.coalesce("m", F.lit(0)), 20))
    assert imputed.count() > 20 and want.filter("NOT (want <=> period_end)").count() == 0 and want.count() == imputed.count()
    unique = out.dropDuplicates(["gvkey", "period_end", "filing_date"]).localCheckpoint()
    alone = {x.id: x.fy_start for x in temporal.fiscal_windows(unique.filter("form = '10-K'")).collect()}
    whole = {x.id: (x.form, x.fy_start) for x in temporal.with_fiscal_starts(unique, F.col("form") == "10-K").collect()}
    assert len(whole) == unique.count() and all(s == alone.get(i) for i, (_, s) in whole.items()) and len(alone) > 20

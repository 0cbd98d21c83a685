"""Events settled by a stream against the batch assignment, under orders of arrival."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import incremental, settling

EVENTS = "firm string, id string, revision bigint, day date"
PERIODS = "firm string, id string, revision bigint, start date, end date"
DAY = date(2020, 1, 1)


def batch(events, periods):
    """Plain assignment by the last revisions: (firm, id) -> (day, period, status)."""
    last = lambda rows: {(r[0], r[1]): r for r in sorted(rows, key=lambda r: r[2])}
    out = {}
    for (firm, i), (*_, day) in last(events).items():
        fits = [(end, start, p) for (f, p), (*_, start, end) in last(periods).items() if f == firm is not None and None not in (start, end, day) and start < day <= end]
        period = min(fits)[2] if fits else None
        out[firm, i] = (day, period, "undated" if day is None else "assigned" if period else "outside")
    return out


def drawn(rng):
    """Events and periods of three firms (one hot, one NULL), with corrections, repeats, withdrawn, nested and wide periods."""
    firms = ["hot"] * 6 + ["b", None]
    events = [(rng.choice(firms), f"e{i}", 0, DAY + timedelta(rng.randint(0, 400)) if rng.random() < 0.85 else None) for i in range(70)]
    events += [(f, i, r + 1, DAY + timedelta(rng.randint(0, 400)) if rng.random() < 0.8 else None) for f, i, r, _ in rng.sample(events, 25)]
    periods = []
    for firm in ("hot", "b"):
        for q in range(5):
            for revision in range(rng.randint(0, 3)):
                start = DAY + timedelta(80 * q + rng.randint(-20, 20))
                gone = revision and rng.random() < 0.2
                periods.append((firm, f"p{q}", revision, None if gone else start, None if gone else start + timedelta(rng.randint(20, 120))))
    periods.append(("hot", "wide", 0, date(1990, 1, 1), date(2030, 1, 1)))
    periods += [("hot", "wide", 1, DAY, DAY + timedelta(30))] * rng.randint(0, 1)
    return events + rng.sample(events, 10), periods + rng.sample(periods, 3)


def run(spark, events, periods, files, at, rng, parts=3):
    """Rows in any order over some files, a file a batch, and the changes of all of them."""
    for name, rows, schema in (("e", events, EVENTS), ("p", periods, PERIODS)):
        rows = rng.sample(rows, len(rows))
        for n in range(files):
            spark.createDataFrame(rows[n::files], schema).coalesce(1).write.mode("append").parquet(str(at / name))
    read = lambda name, schema: incremental.read_arrivals(spark, str(at / name), schema, files_per_trigger=1)
    changes = settling.settle_stream(read("e", EVENTS), read("p", PERIODS), parts)
    settling.write_changes(changes, str(at / "out"), str(at / "checkpoint")).awaitTermination()
    return spark.read.schema(changes.schema).parquet(str(at / "out"))


def found(changes):
    return {(r.firm, r.id): (r.day, r.period, r.status) for r in settling.latest(changes).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_arrival_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    events, periods = drawn(rng)
    changes = run(spark, events, periods, rng.randint(1, 4), tmp_path, rng)
    assert found(changes) == batch(events, periods)
    assert changes.groupBy("firm", "id").agg(F.count_distinct("change").alias("n"), F.count(F.lit(1)).alias("m")).filter("n <> m").count() == 0


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Events first; a second run under the same checkpoint brings the period, a third its revision."""
    rng = random.Random(1)
    events = [("a", "x", 0, DAY), ("a", "y", 0, DAY + timedelta(9)), ("a", "z", 0, None)]
    first = found(run(spark, events, [], 1, tmp_path, rng))
    assert first == {("a", "x"): (DAY, None, "outside"), ("a", "y"): (DAY + timedelta(9), None, "outside"), ("a", "z"): (None, None, "undated")}
    period = ("a", "p", 0, DAY - timedelta(5), DAY + timedelta(5))
    second = run(spark, [], [period], 1, tmp_path, rng)
    assert found(second)["a", "x"] == (DAY, "p", "assigned") and found(second)["a", "y"][2] == "outside"
    n = second.count()
    moved = run(spark, [("a", "z", 1, DAY + timedelta(8))], [("a", "p", 1, DAY, DAY + timedelta(10))], 1, tmp_path, rng)
    got = found(moved)
    assert {k[1]: v[1] for k, v in got.items()} == {"x": None, "y": "p", "z": "p"}
    assert moved.count() == n + 3  # only what changed is told


def test_no_rows(spark, tmp_path):
    assert found(run(spark, [], [], 1, tmp_path, random.Random(0))) == {}

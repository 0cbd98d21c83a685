"""Ordered operators: first and last per key, ranks, duplicates, choice of one, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; ``order`` should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_and_last(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """first_* and last_* of the values by key, in one aggregation."""
    at = F.struct(*order)
    picks = []
    for v in values:
        picks += [F.min_by(v, at).alias(f"first_{v}"), F.max_by(v, at).alias(f"last_{v}")]
    return rows.groupBy(*keys).agg(*picks)


def dense_rank_of(rows: DataFrame, value: str, name: str = "rank", groups: list[str] | None = None) -> DataFrame:
    """Dense rank, greatest first, 0 for NULL.

    Without groups the distinct values are ranked, not the rows: they are counted
    range by range, and each range is numbered on its own.
    """
    if groups:
        w = Window.partitionBy(*groups).orderBy(F.desc_nulls_last(value))
        return rows.withColumn(name, F.when(F.col(value).isNull(), 0).otherwise(F.dense_rank().over(w)))
    levels = with_range(rows.select(value).filter(F.col(value).isNotNull()).distinct(), value)
    counts = levels.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    placed = levels.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(value))))
    ranked = placed.join(F.broadcast(starts), "__range").select(value, (F.col("__at") + F.col("__above")).cast("int").alias(name))
    return rows.join(ranked, value, "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Ranges of values that are sorted on their own, about.
RANGES = 256


def with_range(rows: DataFrame, value: str) -> DataFrame:
    """Add ``__range``: the number of the value's range, in ascending order.  One range has no more than its share.

    Bounds are RANGES of the distinct values, those with the least hash; they decide how even the ranges are, and
    nothing else.
    """
    some = rows.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(F.xxhash64(value), value).limit(RANGES)
    bounds = some.agg(F.sort_array(F.collect_list(value)).alias("__bounds"))  # one row
    return rows.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= F.col(value)))).drop("__bounds")


def copy_number(rows: DataFrame, keys: list[str], order: list[str], name: str = "copy") -> DataFrame:
    """How many rows of the key come before this one."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def shared_flag(rows: DataFrame, keys: list[str], name: str = "is_shared") -> DataFrame:
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def keep_unshared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs once (duplicates go entirely)."""
    return shared_flag(rows, keys, "__shared").filter("NOT __shared").drop("__shared")


def upsert(previous: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Previous rows with the keys of new ones are replaced."""
    return previous.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def choose_one(candidates: DataFrame, case: str, printed: str, gap: str, score: str, live: str, tie: str) -> DataFrame:
    """One candidate per case: id printed first, then the least date gap, the best name score (missing is 100), live sources."""
    order = [F.desc(printed), F.asc_nulls_last(gap), F.desc(F.coalesce(F.col(score), F.lit(100.0))), F.desc(live), F.col(tie)]
    counted = candidates.withColumn("n_acceptable", F.count(F.lit(1)).over(Window.partitionBy(case)))
    return keep_first(counted, [case], order)


def review_flags(conditions: list[tuple[str, Column]]) -> Column:
    """The texts of the conditions that hold, in their order, joined; NULL if none does."""
    found = F.concat_ws("; ", *[F.when(c, F.lit(text)) for text, c in conditions])
    return F.when(found != "", found)


def neighbour_bounds(targets: DataFrame, known: DataFrame, target_id: str, day: str, value: str, bands: tuple[int, ...] = (3, 7, 15, 30), least: int = 8) -> DataFrame:
    """5th and 95th percentile of ``value`` among known rows near in time: the first band of days with ``least`` of them.

    No target meets the rows of its band.  Values are counted by day and range of values; sums of these counts in a
    moving frame of days give the band and the ranges in which the order statistics lie, once for each day of targets.
    Only rows of those ranges (a RANGES-th part each) meet the days, by day and range, and the statistics are picked
    by running counts.  Targets without a day, or with too few rows in every band, get nulls; rows without day or value
    do not count.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    counted = known.filter(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(number.alias("__d"), F.col(value).cast("double").alias("__v"))
    daily = settled(with_range(counted.agg(F.count(F.lit(1)).alias("__n")), "__v"))
    days = targets.filter(F.col(day).isNotNull()).select(number.alias("__d")).distinct()
    # Every range on every day of targets, so that a frame stands on each of them: as many rows as days times ranges.
    grid = days.select("__d", F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("__range"), F.lit(0).cast("long").alias("__n"), F.lit(1).alias("__asked"))
    cells = daily.groupBy("__d", "__range").agg(F.sum("__n").alias("__n")).withColumn("__asked", F.lit(0))
    cells = cells.unionByName(grid).groupBy("__d", "__range").agg(F.sum("__n").alias("__n"), F.max("__asked").alias("__asked"))
    frame = Window.partitionBy("__range").orderBy("__d")
    sums = cells.select("__d", "__range", "__asked", *[F.sum("__n").over(frame.rangeBetween(-b, b)).alias(f"n{b}") for b in bands])
    whole = sums.filter("__asked = 1").groupBy("__d").agg(*[F.sum(f"n{b}").alias(f"n{b}") for b in bands], F.collect_list(F.struct("__range", *[f"n{b}" for b in bands])).alias("__cells"))

    def of_band(b: int) -> Column:
        cells_of = F.transform("__cells", lambda c: F.struct(c["__range"].alias("r"), c[f"n{b}"].alias("n")))
        return F.struct(F.lit(b).alias("band"), F.col(f"n{b}").alias("n"), cells_of.alias("cells"))

    near = whole.select("__d", F.coalesce(*[F.when(F.col(f"n{b}") >= least, of_band(b)) for b in bands]).alias("__b"))
    near = near.filter("__b IS NOT NULL").select("__d", "__b.*")
    # Places of the order statistics, from 0: the percentile lies between two of them.
    at = {"low": (F.col("n") - 1) * F.lit(0.05), "high": (F.col("n") - 1) * F.lit(0.95)}
    asked = F.array(*[F.struct(F.lit(f"{name}{side}").alias("what"), f(p).cast("long").alias("k")) for name, p in at.items() for side, f in enumerate((F.floor, F.ceil))])
    places = near.select("__d", "band", "cells", F.explode(asked).alias("__a")).select("__d", "band", "cells", "__a.*")

    def walk(acc: Column, c: Column) -> Column:
        """The range that holds the k-th row, and how many come before it."""
        here = acc["r"].isNull() & (F.col("k") < acc["before"] + c["n"])
        passed = F.when(acc["r"].isNull() & ~here, acc["before"] + c["n"]).otherwise(acc["before"])
        return F.struct(F.when(here, c["r"]).otherwise(acc["r"]).alias("r"), passed.alias("before"))

    begin = F.struct(F.lit(None).cast("int").alias("r"), F.lit(0).cast("long").alias("before"))
    picked = places.withColumn("__w", F.aggregate(F.array_sort("cells"), begin, walk))
    picked = picked.select("__d", "what", "band", (F.col("k") - F.col("__w.before")).alias("__k"), F.col("__w.r").alias("__range"))
    around = picked.withColumn("__near", F.explode(F.sequence(F.col("__d") - F.col("band"), F.col("__d") + F.col("band"))))
    values = daily.select(F.col("__d").alias("__near"), "__range", "__v", "__n")
    met = around.join(values, ["__near", "__range"]).groupBy("__d", "what", "__k", "__v").agg(F.sum("__n").alias("__n"))
    upto = Window.partitionBy("__d", "what").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stats = met.withColumn("__upto", F.sum("__n").over(upto)).filter(F.col("__upto") > F.col("__k")).groupBy("__d", "what").agg(F.min("__v").alias("__v"))
    found = stats.groupBy("__d").agg(*[F.max(F.when(F.col("what") == f"{name}{side}", F.col("__v"))).alias(f"{name}{side}") for name in at for side in (0, 1)])

    def between(name: str) -> Column:
        p = at[name]
        return F.when(F.floor(p) == F.ceil(p), F.col(f"{name}0")).otherwise((F.ceil(p) - p) * F.col(f"{name}0") + (p - F.floor(p)) * F.col(f"{name}1"))

    by_day = near.select("__d", "band", "n").join(found, "__d").select("__d", "band", between("low").alias("low"), between("high").alias("high"))
    return targets.select(target_id, number.alias("__d")).join(by_day, "__d", "left").drop("__d")


def banded_candidates(left: DataFrame, right: DataFrame, left_day: str, right_day: str, days: int, by: list[str] | None = None) -> DataFrame:
    """All pairs within ``days`` of each other and equal in ``by``, joined on day buckets."""
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    a = left.withColumn("__b", F.explode(F.array(*[number(left_day) + k for k in (-1, 0, 1)])))
    b = right.withColumn("__b", number(right_day))
    return a.join(b, [*(by or []), "__b"]).filter(F.abs(F.datediff(left_day, right_day)) <= days).drop("__b")


def greedy_assignment(pairs: DataFrame, group: str, left: str, right: str, order: str, score: str) -> DataFrame:
    """One-to-one assignment within groups: left rows in ``order`` (then by ``left``) take their best free right row.

    The best is that of the highest ``score``, the least ``right`` of equals.  The rows are those of the sequential
    choice, found in rounds over whole tables: a pair is settled if the right row is the best of those that the left
    one can still have and no left row that can still have it comes earlier.  Nobody who chooses earlier can take it
    then, and nothing better is left, so the sequential choice makes the same pair; the others of both rows go.  The
    first left row of each group is settled in each round at least; where choices do not depend on each other a round
    settles them all.  No group is one task's work, and the rows that are left shrink from round to round.

    Pairs with a null group, left, right or order are no candidates; a null score is the lowest; equal pairs count once.
    """
    keys = [group, left, right]
    rows = pairs.dropna(subset=[*keys, order]).groupBy(*keys).agg(F.min(order).alias("__o"), F.max(score).alias("__s"))
    alive, done = settled(rows), None
    while alive.limit(1).count():
        # A null sorts before all others, so it is the lowest score and the highest of the turned one.
        wish = F.struct(F.col("__s").isNull(), -F.col("__s"), F.col(right))
        best = alive.groupBy(group, left).agg(F.min_by(F.struct(right, "__s", "__o"), wish).alias("__w")).select(group, left, "__w.*")
        first = alive.groupBy(group, right).agg(F.min_by(left, F.struct("__o", left)).alias("__first"))
        found = settled(best.join(first, [group, right]).filter(F.col("__first") == F.col(left)).select(*keys, "__s"))
        done = found if done is None else done.unionByName(found)
        free = alive.join(found.select(group, left), [group, left], "left_anti")
        alive = settled(free.join(found.select(group, right), [group, right], "left_anti"))
    done = alive.select(*keys, "__s") if done is None else done
    return done.select(*keys, F.col("__s").alias(score))

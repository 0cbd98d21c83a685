"""Panels and descriptive aggregates: distinct and conditional counts, pivots, totals, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_range

QUANTILES = (0.10, 0.25, 0.75, 0.90)


def sorted_distinct(column: str, separator: str = "; ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def entity_summary(rows: DataFrame, entity: str, event_id: str, day: str, flags: list[str], labels: str) -> DataFrame:
    """One row per entity: distinct events, first and last day, any-flags, sorted distinct labels."""
    known = rows.filter(F.col(entity).isNotNull())
    return known.groupBy(entity).agg(
        F.countDistinct(event_id).alias("n_events"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        *[F.bool_or(f).alias(f"any_{f}") for f in flags],
        sorted_distinct(labels).alias("labels"),
    )


def event_panel(events: DataFrame, keys: list[str], event_id: str | None, counts: dict[str, Column]) -> DataFrame:
    """Distinct (or plain) counts by key and conditional counts; rows with a NULL key are no panel rows."""
    known = events.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    n = F.countDistinct(event_id) if event_id else F.count(F.lit(1))
    return known.groupBy(*keys).agg(n.alias("n_events"), *[F.count_if(c).alias(name) for name, c in counts.items()])


def pivot_counts(panel: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """One column for each of ``kinds``, zero where there is nothing."""
    return panel.groupBy(*keys).pivot(kind, kinds).agg(F.coalesce(F.sum(value), F.lit(0))).na.fill(0, kinds)


def cooccurrence(wide: DataFrame, kinds: list[str]) -> DataFrame:
    """How many rows show each combination of kinds: pattern ('a+b', 'none') and n_rows."""
    present = F.array(*[F.when(F.col(f"`{k}`") > 0, F.lit(k)) for k in kinds])
    pattern = F.array_join(F.array_compact(present), "+")
    return wide.groupBy(F.when(pattern == "", "none").otherwise(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))


def rollup_total(rows: DataFrame, group: str, measures: dict[str, Column], total: str = "Total") -> DataFrame:
    """Rows by group and a total row that is computed anew (distinct counts do not add up)."""
    rolled = rows.rollup(group).agg(F.grouping(group).alias("__g"), *[c.alias(n) for n, c in measures.items()])
    label = F.when(F.col("__g") == 1, total).otherwise(F.col(group).cast("string"))
    return rolled.withColumn(group, label).drop("__g")


def two_totals(rows: DataFrame, group: str, entity: str) -> DataFrame:
    """Entities by group, then the sum over groups and the number of unique entities."""
    by_group = rows.groupBy(F.col(group).cast("string").alias("label")).agg(F.countDistinct(entity).alias("n"))
    summed = by_group.agg(F.lit("Sum of groups").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    unique = rows.agg(F.lit("Unique").alias("label"), F.countDistinct(entity).alias("n"))
    return by_group.unionByName(summed).unionByName(unique)


def active_gate(panel: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    return panel.join(active.select(*keys).distinct(), keys, "left_semi")


def active_flag(panel: DataFrame, active: DataFrame, keys: list[str], name: str = "is_active") -> DataFrame:
    marked = active.select(*keys).distinct().withColumn(name, F.lit(True))
    return panel.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def active_years(fundamentals: DataFrame, firm: str = "gvkey", year: str = "fyear", day: str = "datadate") -> DataFrame:
    """Firm-years with both a price and shares; the year falls back on the date's."""
    dated = fundamentals.withColumn(year, F.coalesce(F.col(year), F.year(day)))
    return dated.filter(F.col("prcc_f").isNotNull() & F.col("csho").isNotNull()).select(firm, year).distinct()


def quantile_table(rows: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """n, mean, median, sample SD, min, max and interpolated quantiles, all exact.

    A group may hold most of the rows: its distinct values are counted, ranges of them are summed up on their own,
    and the few values at the wanted ranks are picked.
    """
    keys = groups or []
    named = {0.5: "median"} | dict(zip(QUANTILES, ("p10", "p25", "p75", "p90")))
    key = F.struct(*keys) if keys else F.lit(0)
    rows = rows.select(*keys, key.alias("__key"), F.col(value).alias("__v"))
    v = F.col("__v")
    base = rows.groupBy("__key").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    counted = with_range(rows.filter(v.isNotNull()).groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("__c")), "__v")
    upto = Window.partitionBy("__key", "__range").orderBy("__v")
    inside = counted.withColumn("__to", F.sum("__c").over(upto))
    sums = counted.groupBy("__key", "__range").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__key").alias("__k"), F.col("__range").alias("__r"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    totals = base.select(F.col("__key").alias("__g"), F.col("n").alias("__n"))
    placed = inside.join(starts, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")))
    placed = placed.join(totals, F.col("__key").eqNullSafe(F.col("__g")))
    first, last = F.col("__before") + F.col("__to") - F.col("__c"), F.col("__before") + F.col("__to") - 1
    at = {q: (F.col("__n") - 1) * F.lit(q) for q in named}
    holds = lambda rank: (first <= rank) & (rank <= last)
    picks = [f(F.when(holds(r(at[q])), v)).alias(f"{name}_{side}") for q, name in named.items() for side, r, f in (("lo", F.floor, F.max), ("hi", F.ceil, F.max))]
    found = placed.groupBy("__key").agg(*picks, F.any_value("__n").alias("__n")).select(
        F.col("__key").alias("__f"),
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (at[q] - F.floor(at[q]))).alias(n)
            for q, n in named.items()
        ],
    )
    out = base.join(found, F.col("__key").eqNullSafe(F.col("__f")), "left")
    return out.select(*[F.col("__key")[k].alias(k) for k in keys], "n", "mean", "median", "sd", "min", "max", "p10", "p25", "p75", "p90")


def share_of_total(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, sum and percent of the whole by group (NULL percent of a zero whole)."""
    by = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    whole = by.agg(F.sum("total").alias("__whole"))
    return by.join(F.broadcast(whole)).select(group, "n", "total", F.try_divide(100 * F.col("total"), "__whole").alias("pct"))


def event_rates(rows: DataFrame, events: list[str], outcomes: dict[str, str], covered: dict[str, Column] | None = None) -> DataFrame:
    """Outcome rate with and without each event, over the rows where the event is observed.  All in one aggregation."""
    measures = []
    for e in events:
        seen = (covered or {}).get(e, F.lit(True))
        for label, has in (("with", F.col(e) > 0), ("without", F.col(e) == 0)):
            measures += [F.count_if(seen & has).alias(f"{e}|{label}|n"), F.count_if(seen & has & (F.col(outcomes[e]) > 0)).alias(f"{e}|{label}|k")]
    wide = rows.agg(*measures)
    parts = [
        F.struct(
            F.lit(e).alias("event"), F.lit(label).alias("has_event"), F.col(f"`{e}|{label}|n`").alias("n_rows"), F.col(f"`{e}|{label}|k`").alias("n_outcome")
        )
        for e in events
        for label in ("with", "without")
    ]
    return wide.select(F.inline(F.array(*parts))).withColumn("rate", F.try_divide(F.col("n_outcome").cast("double"), F.col("n_rows").cast("double")))


def agreement_rate(rows: DataFrame, groups: list[str], agrees: Column) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(agrees.cast("double")).alias("rate"))


def mode_per_group(rows: DataFrame, groups: list[str], value: Column, name: str = "mode") -> DataFrame:
    """The most frequent value, the least of equals."""
    return rows.groupBy(*groups).agg(F.mode(value, deterministic=True).alias(name))


def top_counts(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, ties by the value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)


def group_verdict(rows: DataFrame, group: str, ladder: list[tuple[str, Column]], otherwise: str, name: str = "verdict") -> DataFrame:
    """The first label of the ladder that any row of the group meets."""
    flags = {f"__f{i}": F.coalesce(F.bool_or(c), F.lit(False)) for i, (_, c) in enumerate(ladder)}
    grouped = rows.groupBy(group).agg(*[c.alias(n) for n, c in flags.items()])
    out = F.lit(otherwise)
    for i, (label, _) in reversed(list(enumerate(ladder))):
        out = F.when(F.col(f"__f{i}"), label).otherwise(out)
    return grouped.select(group, out.alias(name))


def counts_by_key(rows: DataFrame, keys: list[str], renamed: dict[str, str]) -> DataFrame:
    """Sums of many columns by key under new names; rows without a key are left out, empty sums are zero."""
    known = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return known.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in renamed.items()])


def any_flag(*columns: str) -> Column:
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in columns])

"""Joins in time: validity windows, eras, as-of, intervals, periods.

Three conventions of bounds occur and are never mixed: closed years
[from, to], half-open dates [start, end) and periods (start, end].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_FROM, OPEN_TO = 1900, 2099


def validity_join(rows: DataFrame, windows: DataFrame, key: str, year: str, low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """Inner join on ``key`` where ``year`` lies in the closed window; overlapping windows fan out."""
    return rows.join(windows, key).filter(F.col(year).between(F.col(low), F.col(high)))


def with_default_window(rows: DataFrame, windows: DataFrame, keys: list[str], low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """Left join; rows without a window get an open one."""
    joined = rows.join(windows, keys, "left")
    return joined.withColumns({low: F.coalesce(low, F.lit(OPEN_FROM)), high: F.coalesce(high, F.lit(OPEN_TO))})


def in_window_or_unknown(year: Column, low: Column, high: Column) -> Column:
    """An unknown year passes."""
    return year.isNull() | year.between(low, high)


def collapse_windows(windows: DataFrame, keys: list[str], low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    return windows.groupBy(*keys).agg(F.min(low).alias(low), F.max(high).alias(high))


def resolve_by_era(
    rows: DataFrame, eras: DataFrame, blocked: DataFrame, name: str, year: str, key: str, row_id: str, low: str = "valid_from", high: str = "valid_to"
) -> DataFrame:
    """Give names that have eras the key of the one era that covers the year.

    No covering era or more than one: the row goes.  Blocked names go.  Other
    rows keep their key.  ``row_id`` is unique.
    """
    known = eras.select(name).distinct()
    inside = (F.col(year) >= F.col(low)) & (F.col(year) <= F.col(high))
    found = rows.drop(key).join(eras.select(name, key, low, high), name).filter(inside)
    single = found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(row_id))).filter("__n = 1")
    rest = rows.join(known, name, "left_anti").join(blocked.select(name).distinct(), name, "left_anti")
    return rest.unionByName(single.join(blocked.select(name).distinct(), name, "left_anti").select(*rest.columns))


def era_list(windows: DataFrame, name: str, key: str, low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """name -> array of eras in the order of their start."""
    era = F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col(key).alias("key"))
    return windows.groupBy(name).agg(F.array_sort(F.collect_list(era)).alias("eras"))


def era_for_year(eras: Column, year: Column) -> Column:
    """The first era that covers the year; an unknown year takes a list's only era."""
    covering = F.filter(eras, lambda e: (e["low"] <= year) & (year <= e["high"]))
    return F.when(year.isNull(), F.when(F.size(eras) == 1, F.get(eras, 0))).otherwise(F.get(covering, 0))


def two_route_link(rows: DataFrame, by_id: DataFrame, by_name: DataFrame, id_col: str, name: str, year: str) -> DataFrame:
    """Link by id where the id is known, even if no era of it covers the year; else by name."""
    ids = by_id.select(F.col(id_col), F.col("eras").alias("__id_eras"))
    names = by_name.select(F.col(name), F.col("eras").alias("__name_eras"))
    joined = rows.join(ids, id_col, "left").join(names, name, "left")
    known = F.col("__id_eras").isNotNull()
    era = F.when(known, era_for_year(F.col("__id_eras"), F.col(year))).otherwise(era_for_year(F.col("__name_eras"), F.col(year)))
    route = F.when(era.isNull(), None).when(known, "fei_exact").otherwise("name_normalized")
    return joined.withColumns({"link_key": era["key"], "link_source": route}).drop("__id_eras", "__name_eras")


def conflicting_keys(windows: DataFrame, name: str, key: str, low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """Names with two windows that overlap in time and have different keys.

    In the order of their starts, some window then starts before the latest end
    so far, which belongs to another key: of the pairs that overlap, the first to
    be complete in this order always shows.  No pairs are built.
    """
    order = Window.partitionBy(name).orderBy(low, high, key).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct(F.col(high).alias("end"), F.col(key).alias("key"))).over(order)
    seen = windows.withColumn("__latest", latest)
    return seen.filter((F.col("__latest")["end"] >= F.col(low)) & (F.col("__latest")["key"] != F.col(key))).select(name).distinct()


def drop_conflicts(windows: DataFrame, name: str, key: str, low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    return windows.join(conflicting_keys(windows, name, key, low, high), name, "left_anti")


def merge_eras(windows: DataFrame, by: list[str], low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """Closed years [low, high] that overlap or follow on each other, as one; those apart stay apart.

    ``collapse_windows`` is the wide form, which also closes the gaps between.
    """
    order = Window.partitionBy(*by).orderBy(low, high)
    latest = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(low) <= latest + 1, 0).otherwise(1)
    marked = windows.select(*by, low, high).distinct().withColumn("__opens", opens)
    islands = marked.withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def inherited_eras(cited: DataFrame, windows: DataFrame, id_col: str, name: str, key: str, low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """(id, key, low, high): the eras of the names that an id is cited with.

    Names whose own eras conflict pass nothing on, and an id whose inherited
    eras conflict has none at all, rather than a guess.  An empty or unknown
    id or name is no link.
    """
    sound = drop_conflicts(windows.filter(F.col(name) != ""), name, key, low, high)
    pairs = cited.filter((F.col(id_col) != "") & (F.col(name) != "")).select(id_col, name).distinct()
    eras = merge_eras(pairs.join(sound, name), [id_col, key], low, high)
    return drop_conflicts(eras, id_col, key, low, high)


def _carried(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str) -> list[str]:
    """Columns of the left that ride along: all but the keys and the time, where both sides have these in one type."""
    same = {on} if left.schema[on].dataType == right.schema[right_on].dataType else set()
    same |= {k for k in by if left.schema[k].dataType == right.schema[k].dataType}
    return [c for c in left.columns if c not in same]


def _interleaved(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, values: list[str], ties: list[str]) -> DataFrame:
    """Both sides as rows of one width; what would stand in a row twice is left out, since every row is sorted twice."""
    payload = F.struct(F.col(right_on).alias("__at"), *[F.col(v) for v in values])
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    own = _carried(left, right, by, on, right_on)
    mine = left.select(*by, F.col(on).alias("__ts"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(own)], empty.alias("__hit"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"__t{i}") for i, t in enumerate(ties)])
    none = [F.lit(None).cast(left.schema[c].dataType).alias(f"__l{i}") for i, c in enumerate(own)]
    theirs = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__ts"), F.lit(1).alias("__side"), *none, payload.alias("__hit"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)])
    return mine.unionByName(theirs)


def _ordered(ties: list[str]) -> list[str]:
    return ["__ts", "__side", *[f"__t{i}" for i in range(len(ties))]]


def _nearest(both: DataFrame, by: list[str], ties: list[str], forward: bool) -> DataFrame:
    """``__found``: the last hit up to each row, or the first from it on.

    A key may hold most of the rows, so its rows are split by month and each
    (key, month) is sorted on its own; a month's last (first) hit is carried
    over the months of the key in a second, small window.  Rows without a time
    find nothing.
    """
    pieces = both.withColumn("__month", F.trunc(F.col("__ts").cast("date"), "month"))
    edge = (Window.currentRow, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, Window.currentRow)
    pick = F.first if forward else F.last
    within = Window.partitionBy(*by, "__month").orderBy(*_ordered(ties))
    near = pieces.withColumn("__near", pick("__hit", ignorenulls=True).over(within.rowsBetween(*edge)))
    # What a month carries over is what its outermost row finds: the same shuffle and sort as for all its rows.
    outermost = (F.lag if forward else F.lead)(F.lit(1)).over(within).isNull()
    ends = near.withColumn("__outermost", outermost).filter("__outermost").select(*by, "__month", F.col("__near").alias("__end"))
    beyond = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    carried = ends.withColumn("__far", pick("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__month").rowsBetween(*beyond)))
    keys = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*by, "__month")]
    joined = near.alias("n").join(carried.select(*by, "__month", "__far").alias("c"), keys, "left")
    return joined.select(*[F.col(f"n.{c}") for c in near.columns if c not in ("__near", "__month")], F.coalesce("__near", "__far").alias("__found"))


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, values: list[str], tolerance_days: int | None = None, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Left rows with ``values`` of the latest right row strictly before them (last of equals by ``ties``).

    Both sides are sorted together by key and time; no pairs are built.  A gap
    of exactly the tolerance matches.
    """
    both = _nearest(_interleaved(left, right, by, on, right_on, values, list(ties)), by, list(ties), forward=False)
    return _matched(both, left, _carried(left, right, by, on, right_on), on, values, lambda ts, at: F.lit(True) if tolerance_days is None else ts <= at + F.expr(f"interval {tolerance_days} days"))


def asof_forward(
    left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, values: list[str], ties: tuple[str, ...] = ()
) -> DataFrame:
    """Left rows with ``values`` of the first right row at or after them (first of equals by ``ties``)."""
    both = _nearest(_interleaved(left, right, by, on, right_on, values, list(ties)), by, list(ties), forward=True)
    return _matched(both, left, _carried(left, right, by, on, right_on), on, values, lambda ts, at: F.lit(True))


def _matched(rows: DataFrame, left: DataFrame, own: list[str], on: str, values: list[str], near) -> DataFrame:
    kept = rows.filter("__side = 0")
    ok = F.col("__found").isNotNull() & F.col("__ts").isNotNull() & near(F.col("__ts"), F.col("__found")["__at"])
    mine = [F.col(f"__l{own.index(c)}" if c in own else "__ts" if c == on else c).alias(c) for c in left.columns]
    return kept.select(*mine, *[F.when(ok, F.col("__found")[v]).alias(v) for v in values])


def assign_to_period(events: DataFrame, periods: DataFrame, by: list[str], day: str, keys: list[str], start: str = "period_start", end: str = "period_end") -> DataFrame:
    """Give events the keys of the period (start, end] that holds their day; NULL keys outside of all."""
    found = asof_forward(events, periods, by, day, end, [start, *keys], ties=(start,))
    inside = F.col(day) > F.col(start)
    return found.withColumns({k: F.when(inside, F.col(k)) for k in keys}).drop(start)


def assign_in_one_sweep(events: DataFrame, by: list[str], day: str, windows: dict[str, DataFrame]) -> DataFrame:
    """Give events, for each kind of windows, a struct of the keys of the window (start, end] that holds their day; NULL outside of all.

    ``windows``: by kind, the columns ``by``, start, end and keys.  What a day
    finds is what ``assign_to_period`` finds for each kind alone: the first end
    at or after it, the least start of equals.  Events and windows of all kinds
    are shuffled and sorted once, by key and not by month, so events are to come
    summed up by key and day: then no key has more rows than days and windows.
    """
    rows = events.select(*[c for c in events.columns if c != day], F.col(day).alias("__ts"), F.lit(0).alias("__side"))
    for kind, of in windows.items():
        keys = [c for c in of.columns if c not in (*by, "end")]  # the start is the first
        hits = of.filter("end IS NOT NULL").select(*by, F.col("end").alias("__ts"), F.lit(1).alias("__side"), F.col("start").alias("__start"), F.struct(*keys).alias(f"__{kind}"))
        rows = rows.unionByName(hits, allowMissingColumns=True)
    # Latest first, so that the frame only grows; the exact reverse of by time, events before ends, by start.
    seen = Window.partitionBy(*by).orderBy(F.desc("__ts"), F.desc("__side"), F.desc("__start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({f"__{kind}": F.last(f"__{kind}", ignorenulls=True).over(seen) for kind in windows}).filter("__side = 0")
    picked = {kind: F.struct(*[F.col(f"__{kind}")[c].alias(c) for c in of.columns if c not in (*by, "start", "end")]) for kind, of in windows.items()}
    inside = lambda kind: F.col("__ts") > F.col(f"__{kind}")["start"]
    own = [F.col("__ts").cast(events.schema[day].dataType).alias(day) if c == day else F.col(c) for c in events.columns]
    return found.select(*own, *[F.when(inside(kind), keys).alias(kind) for kind, keys in picked.items()])


def half_open_pick(rows: DataFrame, windows: DataFrame, key: str, day: str, start: str, end: str, position: str, values: list[str], row_id: str) -> DataFrame:
    """Left join to the first window [start, end) by ``position`` that holds the day; an open end is NULL.

    ``row_id`` tells rows apart, so equal rows stay apart and columns of any type pass.
    """
    inside = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{day}") >= F.col(f"r.{start}")) & (F.col(f"r.{end}").isNull() | (F.col(f"l.{day}") < F.col(f"r.{end}")))
    joined = rows.alias("l").join(windows.alias("r"), inside, "left")
    payload = F.struct(*[F.col(f"r.{v}").alias(v) for v in values])
    own = F.struct(*[F.col(f"l.{c}").alias(c) for c in rows.columns])
    best = joined.groupBy(F.col(f"l.{row_id}")).agg(F.any_value(own).alias("__row"), F.min_by(payload, F.col(f"r.{position}")).alias("__v"))
    return best.select(*[F.col("__row")[c].alias(c) for c in rows.columns], *[F.col("__v")[v].alias(v) for v in values])


def period_starts(
    rows: DataFrame, by: list[str], end: str, order: list[str], most_gap: int, months_back: int, name: str = "period_start", among: Column | None = None
) -> DataFrame:
    """The previous end of the entity if the gap is 1..most_gap days, else ``months_back`` months before the end.

    With ``among`` only such rows have starts and count as previous ones.
    """
    window = Window.partitionBy(*by).orderBy(end, *order)
    if among is None:
        previous = F.lag(end).over(window)
    else:
        previous = F.last(F.when(among, F.col(end)), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.datediff(F.col(end), previous)
    start = F.when(gap.between(1, most_gap), previous).otherwise(F.add_months(end, -months_back))
    return rows.withColumn(name, start if among is None else F.when(among, start))


def reporting_periods(filings: DataFrame, firm: str = "gvkey", filed: str = "filing_date", reported: str = "report_date", trigger_days: int = 8, lead_days: int = 20, most_gap: int = 120) -> DataFrame:
    """Reporting periods of filings: period ends too near the filing are imputed from the firm's cycle.

    Adds period_end_imputed, period_end, reporting_year, reporting_quarter and period_start.
    """
    from ledgerloom.functions.dates import cycle_month_end, nearest_month_end

    near = F.datediff(F.col(filed), F.col(reported)) < trigger_days
    imputed = F.col(reported).isNull() | near
    marked = filings.withColumns({"period_end_imputed": imputed, "__end": F.when(~imputed, F.col(reported))})
    snapped = nearest_month_end(F.col("__end"))
    # The most frequent month mod 3 among reliable ends, the least of equals; 0 without any. The firm's rows are in one place for their starts anyway.
    cycle = F.mode(F.month(snapped) % 3, deterministic=True).over(Window.partitionBy(firm))
    joined = marked.withColumn("__cycle", F.coalesce(F.when(F.col(firm).isNotNull(), cycle), F.lit(0)))
    end = F.coalesce("__end", cycle_month_end(F.col(filed), F.col("__cycle"), lead_days))
    ended = joined.withColumn("period_end", end)
    label = nearest_month_end(F.col("period_end"))
    labelled = ended.withColumns({"reporting_year": F.year(label), "reporting_quarter": F.quarter(label)})
    return period_starts(labelled, [firm], "period_end", [filed], most_gap, 3).drop("__end", "__cycle")


def with_fiscal_starts(filings: DataFrame, annual: Column, firm: str = "gvkey", end: str = "period_end", filed: str = "filing_date", most_gap: int = 400) -> DataFrame:
    """All filings, the annual ones with ``fy_start`` as by ``fiscal_windows``."""
    return period_starts(filings, [firm], end, [filed], most_gap, 12, "fy_start", annual)


def fiscal_windows(annual: DataFrame, firm: str = "gvkey", end: str = "period_end", filed: str = "filing_date", most_gap: int = 400) -> DataFrame:
    """Fiscal-year windows (fy_start, period_end] of annual filings."""
    return period_starts(annual, [firm], end, [filed], most_gap, 12, "fy_start")

"""Events that wait in state for their period, and move when it is revised.

``settle_stream`` takes events and periods in any order of arrival and tells
every change of an event's period; ``latest`` of these changes is the batch
assignment by the last revisions, whatever came first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.sources.sinks import write_partitions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "firm string, part int, id string, day int, period string, change bigint"
PART = "changes bigint, days bigint, periods array<struct<id: string, revision: bigint, low: int, high: int>>, few array<struct<id: string, revision: bigint, day: int>>"
#: Events that a part keeps in one row of state; more of them are kept in maps.
FEW = 100
#: Rows of a firm's part that are worked on at once.
CHUNK = 10_000
#: Kept days that one call of the state lists, about; a revision lists them unless the days of its span are fewer calls.
KEYS_A_CALL = 100


class _Known:
    """Periods (low, high] in the order in which a day picks one."""

    def __init__(self, periods: dict):
        self.order = sorted((high, low, k) for k, (_, low, high) in periods.items() if low is not None and high is not None)

    def pick(self, day: int | None) -> str | None:
        if day is None:
            return None
        at = bisect_left(self.order, (day,))
        return next((k for _, low, k in self.order[at:] if low < day), None)


class _Settle(StatefulProcessor):
    """State of one part of a firm: one row with its periods and few events, or maps of events by id and ids by day.

    A call of the state costs far more than a row, so most parts are one row, read and written once a batch.  Events
    move to the maps when they are more than ``FEW``, or at once if they are let go one by one.  The days of the map
    are counted (those let go too), so that a revision takes the shorter way to the days that it may move.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.part = handle.getValueState("part", PART)
        self.seen = handle.getMapState("seen", "id string", "revision bigint, day int", self.keep_ms)
        self.days = handle.getMapState("days", "day int", "ids array<string>", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, self.n_days, held, few = self.part.get() or (0, 0, (), None if self.keep_ms else ())
        periods = {k: tuple(v) for k, *v in held}
        self.few = None if few is None else {k: tuple(v) for k, *v in few}
        known = _Known(periods)
        while chunk := list(islice(rows, CHUNK)):
            told: list[tuple] = []
            known = self._revise(self._newest(chunk, "period"), periods, known, told)
            self._arrive(self._newest(chunk, "event"), known, told)
            for change, (k, day, period) in enumerate(told, n):
                yield Row(firm=key[0], part=key[1], id=k, day=day, period=period, change=change)
            n += len(told)
        listed = lambda rows: None if rows is None else [(k, *v) for k, v in rows.items()]
        self.part.update((n, self.n_days, listed(periods), listed(self.few)))

    @staticmethod
    def _newest(rows: list[Row], kind: str) -> dict:
        """id -> (revision, day or low, high) of the last revision in these rows."""
        newest: dict = {}
        for r in rows:
            if r.kind == kind and (r.id not in newest or newest[r.id][0] < r.revision):
                newest[r.id] = (r.revision, r.low_or_day, r.high)
        return newest

    def _revise(self, came: dict, periods: dict, known: _Known, told: list) -> _Known:
        """Take in later revisions, and tell the events whose pick they change."""
        later = {k: v for k, v in came.items() if k not in periods or periods[k][0] < v[0]}
        spans = [v[1:] for k in later for v in (periods.get(k), later[k]) if v and None not in v]
        periods.update(later)
        new = _Known(periods) if later else known
        if not spans or not (self.few or self.n_days):
            return new
        if self.few:
            told += [(k, day, new.pick(day)) for k, (_, day) in self.few.items() if new.pick(day) != known.pick(day)]
            return new
        if sum(high - low for low, high in spans) > self.n_days / KEYS_A_CALL:
            touched = [k[0] for k in self.days.keys()]
        else:
            touched = sorted({d for low, high in spans for d in range(low + 1, high + 1)})
        for day in touched:
            period = new.pick(day)
            if period != known.pick(day):
                kept = self.days.getValue((day,))
                told += [(k, day, period) for k in (kept[0] if kept else ())]
        return new

    def _arrive(self, came: dict, known: _Known, told: list) -> None:
        """Events that are new or corrected; a row that came before is passed over."""
        if self.few is not None:
            for k, (revision, day, _) in came.items():
                if k not in self.few or self.few[k][0] < revision:
                    self.few[k] = (revision, day)
                    told.append((k, day, known.pick(day)))
            if len(self.few) > FEW:
                self._unfold()
            return
        added: dict[int, list[str]] = {}
        for k, (revision, day, _) in came.items():
            prior = self.seen.getValue((k,))
            if prior is not None and prior[0] >= revision:
                continue
            self.seen.updateValue((k,), (revision, day))
            told.append((k, day, known.pick(day)))
            if prior is not None and prior[1] is not None:
                if prior[1] == day:
                    continue
                kept = self.days.getValue((prior[1],))
                self.days.updateValue((prior[1],), ([x for x in (kept[0] if kept else ()) if x != k],))
            if day is not None:
                added.setdefault(day, []).append(k)
        for day, ids in added.items():
            kept = self.days.getValue((day,))
            self.n_days += kept is None
            self.days.updateValue((day,), ([*(kept[0] if kept else ()), *ids],))

    def _unfold(self) -> None:
        """Events go from the row of the part to the maps."""
        by_day: dict[int, list[str]] = {}
        for k, (revision, day) in self.few.items():
            self.seen.updateValue((k,), (revision, day))
            if day is not None:
                by_day.setdefault(day, []).append(k)
        for day, ids in by_day.items():
            self.days.updateValue((day,), (ids,))
        self.few, self.n_days = None, len(by_day)

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, periods: DataFrame, parts: int = 8, keep_days: int | None = None) -> DataFrame:
    """Changes (firm, part, id, day, period, status, change) of events against periods (start, end], both of them streams.

    ``events``: (firm, id, revision, day); ``periods``: (firm, id, revision,
    start, end).  The highest revision of an id counts; rows with a revision
    that is known are repeats.  Of periods that hold a day, the one that ends
    first is picked, then starts first, then has the least id; one revised to
    NULL bounds is withdrawn.  An event outside of all periods waits, one
    without a day waits for a revision that has one; both are told as such at
    once, nothing is dropped.  Ids are not NULL and stay with their firm;
    without a firm there are no periods.

    A firm's events are spread over ``parts`` tasks by their id and its
    periods, few beside them, are sent to each, so that a firm with most of
    the events is no single task.  ``parts`` is part of the checkpoint.
    Events are let go ``keep_days`` after their last change, if that is set;
    later revisions do not move them any more.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    given = F.when(F.col("id").isNull(), F.raise_error(F.lit("events and periods need ids"))).otherwise(F.col("id").cast("string"))
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    firm, revision = F.col("firm").cast("string").alias("firm"), F.col("revision").cast("bigint").alias("revision")
    none = F.lit(None).cast("int").alias("high")
    e = events.select(firm, given.alias("id"), revision, F.lit("event").alias("kind"), days("day").alias("low_or_day"), none)
    e = e.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    p = periods.filter("firm IS NOT NULL").select(firm, given.alias("id"), revision, F.lit("period").alias("kind"), days("start").alias("low_or_day"), days("end").alias("high"))
    p = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keep_ms = None if keep_days is None else keep_days * 86_400_000
    mode = "None" if keep_days is None else "ProcessingTime"
    told = e.unionByName(p).groupBy("firm", "part").transformWithState(_Settle(keep_ms), CHANGES, "Update", mode)
    status = F.when(F.col("day").isNull(), "undated").when(F.col("period").isNull(), "outside").otherwise("assigned")
    return told.withColumns({"day": F.date_from_unix_date("day"), "status": status})


def write_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Changes by batch; a batch that is repeated replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        write_partitions(rows.withColumn("batch", F.lit(number)), target, ["batch"])

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each event: firm, id, day, period, status."""
    last = F.max_by(F.struct("day", "period", "status"), "change")
    return changes.groupBy("firm", "id").agg(last.alias("__last")).select("firm", "id", "__last.*")

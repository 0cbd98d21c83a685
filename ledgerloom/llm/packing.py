"""Packing of tokenized documents into sequences: dominance reduction, then best fit.

Only lengths matter to the packing, and there are at most ``capacity`` of
them.  The pieces are counted by length (a table of bounded size), the bins
are planned on those counts, and every piece finds its place in the plan by
its rank among the pieces of its length.

Dominance (Martello and Toth).  A set of pieces is fixed as one sequence where
it provably dominates every other set with the same piece i:
* i with a partner k of exactly the rest: whatever i shares a bin with in an
  optimal solution fits the place of k;
* i alone, if the smallest other piece does not fit;
* i with the largest partner k that fits, if no two others fit together;
* the same, if no three others fit and no two that fit hold more than k.
Each fixing shrinks the instance and is repeated for as many copies as there
are.  What remains is packed by best fit, longest pieces first.

Defined cases: a null text is empty, and so a piece of the end id alone; an
empty table gives an empty result; repeated rows are packed one by one; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, inline_rows, ranked, stored
from .tokens import Encoder, TokenizerSpec, end_with, slices

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked in one task, about.
RANK_ROWS = 100_000

#: (number of bins, runs of (length, pieces in the bin))
Pattern = tuple[int, list[tuple[int, int]]]


def _others(left: dict[int, int], i: int) -> list[int]:
    """The lengths besides one piece i, ascending, each at most three times."""
    out: list[int] = []
    for length in sorted(left):
        out += [length] * min(3, left[length] - (length == i))
    return out


def _dominating(left: dict[int, int], i: int, capacity: int) -> list[int] | None:
    """Partners of i in a set that dominates all sets with i, or None if none is known to."""
    rest = capacity - i
    other = _others(left, i)
    fit = other[: bisect_right(other, rest)]
    if not fit:
        return []
    k = fit[-1]
    if k == rest or len(fit) < 2 or fit[0] + fit[1] > rest:
        return [k]
    if len(fit) > 2 and fit[0] + fit[1] + fit[2] <= rest:
        return None
    best, low, high = 0, 0, len(fit) - 1
    while low < high:
        if fit[low] + fit[high] <= rest:
            best = max(best, fit[low] + fit[high])
            low += 1
        else:
            high -= 1
    return [k] if best <= k else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed bins, and the counts that are left."""
    left = {k: n for k, n in counts.items() if n}
    fixed: list[Pattern] = []

    def fix(i: int, partner: int | None) -> None:
        if partner is None:
            times, runs = left[i], [(i, 1)]
        elif partner == i:
            times, runs = left[i] // 2, [(i, 2)]
        else:
            times, runs = min(left[i], left[partner]), [(i, 1), (partner, 1)]
        fixed.append((times, runs))
        for length, per in runs:
            left[length] -= times * per
            if not left[length]:
                del left[length]

    for i in sorted(left, reverse=True):  # exact partners first: they stay dominating whatever else is fixed
        if i == capacity:
            fix(i, None)
        elif i in left and capacity - i in left and (2 * i != capacity or left[i] > 1):
            fix(i, capacity - i)
    again = True
    while again:
        again = False
        for i in sorted(left, reverse=True):
            if i in left and (partners := _dominating(left, i, capacity)) is not None:
                fix(i, partners[0] if partners else None)
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing: equal pieces at once, equal bins as one entry."""
    bins: dict[int, list[Pattern]] = defaultdict(list)  # by room left

    def put(room: int, times: int, runs: list[tuple[int, int]]) -> None:
        if times:
            bins[room].append((times, runs))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in bins if r >= length):  # the least room first; a bin takes pieces until none fits
            per, waiting = room // length, bins.pop(room)
            while waiting and left:
                times, runs = waiting.pop()
                full = min(times, left // per)
                put(room - per * length, full, [*runs, (length, per)])
                left, times = left - full * per, times - full
                if times and left:  # fewer than fill another bin
                    put(room - left * length, 1, [*runs, (length, left)])
                    left, times = 0, times - 1
                put(room, times, runs)
            bins[room] += waiting
        per = capacity // length
        put(capacity - per * length, left // per, [(length, per)])
        if left % per:
            put(capacity - left % per * length, 1, [(length, left % per)])
    return [p for group in bins.values() for p in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[dict]:
    """Slots: pieces of ``length`` with ranks in [low, high) go to sequence first + (rank - low) // per."""
    fixed, left = reduce_by_dominance(counts, capacity)
    slots, used, first = [], defaultdict(int), 0
    for times, runs in fixed + best_fit(left, capacity):
        offset = 0
        for length, per in runs:
            low = used[length]
            used[length] += times * per
            slots.append({"length": length, "low": low, "high": used[length], "first": first, "per": per, "at": offset})
            offset += per * length
        first += times
    return slots


def encode_pieces(docs: DataFrame, spec: TokenizerSpec, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece.

    A document longer than ``capacity`` is cut into pieces of it; the first may be shorter.
    """
    schema = "doc_id long, piece int, start long, length int, ids binary"
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(spec)
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                offsets, ids = end_with(*encoder.encode(texts.slice(low, high - low)), end_id)
                sizes = np.diff(offsets)
                pieces = -(-sizes // capacity)
                which = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity  # length of the first piece
                start = np.where(number == 0, 0, head[which] + (number - 1) * capacity)
                length = np.where(number == 0, head[which], capacity)
                at = np.append(offsets[which] + start, offsets[-1]).astype(np.int32) * 4
                binary = pa.Array.from_buffers(
                    pa.binary(), len(which), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4").tobytes())]
                )
                doc = batch.column("doc_id").slice(low, high - low).take(pa.array(which))
                columns = [doc, number.astype(np.int32), start.astype(np.int64), length.astype(np.int32), binary]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow)

    return documents(docs).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces``: a stored table with doc_id, piece, start and length; it is read three times.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = inline_rows(spark, plan(counts, capacity), "length int, low long, high long, first long, per long, at long")
    most = max(counts.values(), default=1)
    buckets = max(64, -(-most // RANK_ROWS))
    rows = ranked(
        pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), "__rank"
    )
    # Slots: two for each length and bin pattern; their number depends on the capacity, not on the input.
    inside = (rows["length"] == slots["length"]) & (rows["__rank"] >= slots["low"]) & (rows["__rank"] < slots["high"])
    within = F.col("__rank") - F.col("low")
    return rows.join(F.broadcast(slots), inside).select(
        *[rows[c] for c in pieces.columns],
        (F.col("first") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(within, F.col("per")) * rows["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, spec: TokenizerSpec, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    encoded = encode_pieces(docs, spec, end_id, capacity)
    thin = encoded.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    with arrow_rows(docs.sparkSession, 1500):
        thin = stored(thin, "pieces")
    return pack(thin, capacity).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces with ``ids`` and their places."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))  # ``capacity`` ids at most
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))

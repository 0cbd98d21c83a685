"""Byte-level BPE by Spark's higher-order functions.

A fold over the bytes of a word merges the adjacent pair of lowest rank,
leftmost first, until no pair has a rank.  The ranks are one literal map: a
pair (a, b) of ids has its rank at ``place[a] + b`` of a table that rows of all
left ids share.  One number holds a piece: the rank of its pair with the next
piece, its place in the word and its id, so that the least number is the pair
to merge and a merged pair's rank is its id.

Distinct words are folded, not occurrences.  An Arrow pass turns blocks of
documents (``BLOCK_BYTES`` of text) into their distinct words and the numbers
of all words; the blocks are written to the shared folder.  The words of all
blocks are counted, the most frequent (``KEPT_WORDS`` at most) are folded once
for the whole corpus, and the rest once in each block.  How many are kept
changes the time, not the result.  A last Arrow pass puts the ids together.
Decoding concatenates the pieces of the ids.

A word of more than ``LONG_WORD`` bytes, for which a fold's work would grow
with the square, is merged by the same rule with a heap in the Arrow pass.

Defined cases: a null text is empty and has no ids; an empty table gives an
empty result; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, stored
from .tokens import cut, laid_out, slices, spliced

#: Frequent words that every worker knows, at most.
KEPT_WORDS = 600_000
#: Text bytes of a block of documents, about; a longer document is a block by itself.
BLOCK_BYTES = 4_000_000
#: Blocks that a worker gets at a time.
BATCH_BLOCKS = 4
#: Bytes of a word beyond which a heap merges.
LONG_WORD = 256
NO_RANK = 0xFFFF
ID_BITS, PLACE_BITS = 16, 31
RANK_SHIFT = ID_BITS + PLACE_BITS


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) >= NO_RANK:
        raise ValueError("ids must be below 65535")
    return ranks


def pieces_by_id(path: str) -> list[bytes]:
    """The bytes of every id, empty for an id that the file leaves free."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


@cache
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """The rank of every two pieces that merge."""
    ranks = load_ranks(path)
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def displaced(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(place of each left id, cells): pair (a, b) is in cell place[a] + b as a * 65536 + rank; free cells hold -1."""
    rows = defaultdict(list)
    for a, b in pairs:
        rows[a].append(b)
    size = 1 + max(max(p) for p in pairs)
    place = [0] * size
    taken = np.zeros(4 * size + 4 * len(pairs), bool)
    cells = np.full(len(taken), -1, np.int64)
    window, start, held = np.arange(2048), 0, 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        right = np.array(sorted(rows[a]))
        if len(right) != held:  # rows of one size look on from where the last one went, which is quicker than closest
            start, held = 0, len(right)
        while True:
            spots = start + np.flatnonzero(~taken[start + window])  # for the first cell of the row
            for step in (right[1:] - right[0]).tolist():
                if not len(spots):
                    break
                spots = spots[~taken[spots + step]]
            if len(spots):
                break
            start += len(window)
        start = int(spots[0])
        place[a] = start - int(right[0])  # may be negative; the sum with a right id is not
        taken[right + place[a]] = True
        cells[right + place[a]] = [a * 65536 + pairs[a, b] for b in right.tolist()]
    end = int(np.flatnonzero(taken)[-1]) + 1
    return place, cells[:end].tolist()


def _constant(value: object, kind: str) -> Column:
    """A literal; the optimizer folds the parsing away."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@cache
def _rank_json(path: str) -> tuple[list[int], list[int], list[int], list[int]]:
    pairs, ranks = pair_ranks(path), load_ranks(path)
    single = [ranks[bytes([i])] for i in range(256)]
    first = [pairs.get((single[x], single[y]), NO_RANK) for x in range(256) for y in range(256)]
    return *displaced(pairs), single, first


def rank_map(path: str) -> Column:
    """The literal: place, cells, the ids of single bytes and the ranks of two bytes."""
    place, cells, single, first = _rank_json(path)
    return F.struct(
        _constant(place, "array<int>").alias("place"),
        _constant(cells, "array<bigint>").alias("cells"),
        _constant(single, "array<bigint>").alias("single"),
        _constant(first, "array<bigint>").alias("first"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value``: the start of an empty fold, which its last function receives (cheaper than an array of one)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def fold_word(word: Column, ranks: Column) -> Column:
    """Ids of a word that is not empty: ranked merges folded over its bytes.  ``ranks``: a ``rank_map``."""
    low = F.lit((1 << RANK_SHIFT) - 1)
    id_mask = F.lit((1 << ID_BITS) - 1)
    place_mask = F.lit(((1 << PLACE_BITS) - 1) << ID_BITS)
    none = F.lit(NO_RANK).cast("long")
    all_after = F.lit(1 << 30)

    def rank(a: Column, b: Column) -> Column:
        cell = F.get(ranks["cells"], (F.get(ranks["place"], a.cast("int")) + b).cast("int"))
        return let(cell, lambda c: F.when(F.shiftright(c, 16) == a, c.bitwiseAND(F.lit(NO_RANK))).otherwise(none))

    def step(pieces: Column, _: Column) -> Column:
        def at_least(least: Column) -> Column:
            found = let(F.array_position(pieces, least).cast("int"), lambda p: merge(pieces, least, p))
            return F.when(least >= F.lit(NO_RANK << RANK_SHIFT), pieces).otherwise(found)

        return let(F.array_min(pieces), at_least)

    def merge(pieces: Column, least: Column, p: Column) -> Column:
        """``p``: the place (from 1) of the left piece of the pair, whose number is ``least``."""

        def joined(new: Column) -> Column:
            after = F.get(pieces, p + 1).bitwiseAND(id_mask)  # null at the end, and so without a rank
            whole = F.shiftleft(rank(new, after), RANK_SHIFT).bitwiseOR(least.bitwiseAND(place_mask)).bitwiseOR(new)
            before = let(
                F.get(pieces, p - 2),
                lambda e: F.shiftleft(rank(e.bitwiseAND(id_mask), new), RANK_SHIFT).bitwiseOR(e.bitwiseAND(low)),
            )
            rest = F.slice(pieces, p + 2, all_after)
            at_start = F.concat(F.array(whole), rest)
            return F.when(p == 1, at_start).otherwise(F.concat(F.slice(pieces, F.lit(1), p - 2), F.array(before, whole), rest))

        return let(F.shiftright(least, RANK_SHIFT), joined)

    def pieces_of(codes: Column) -> Column:
        def piece(code: Column, i: Column) -> Column:
            pair = F.coalesce(F.get(ranks["first"], code * 256 + F.get(codes, i + 1)), none)
            return F.shiftleft(pair, RANK_SHIFT).bitwiseOR(F.shiftleft(i.cast("long"), ID_BITS)).bitwiseOR(F.get(ranks["single"], code))

        return F.transform(codes, piece)

    def folded(pieces: Column) -> Column:
        end = F.when(F.size(pieces) < 2, pieces).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(pieces)), pieces, step))
        return F.transform(end, lambda e: e.bitwiseAND(id_mask).cast("int"))

    one_char_a_byte = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return let(F.transform(one_char_a_byte, F.ascii), lambda codes: let(pieces_of(codes), folded))


def merge_long(word: bytes, path: str) -> list[int]:
    """The same merges by a heap: for words whose fold would take too long."""
    pairs, ranks = pair_ranks(path), load_ranks(path)
    ids = [ranks[word[i : i + 1]] for i in range(len(word))]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapify(heap)
    while heap:
        rank, i, left, right = heappop(heap)
        j = after[i]
        if ids[i] != left or j >= len(ids) or ids[j] != right:
            continue  # one of the two has merged since
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        if k < len(ids):
            before[k] = i
            if (r := pairs.get((rank, ids[k]))) is not None:
                heappush(heap, (r, i, rank, ids[k]))
        if (h := before[i]) >= 0 and (r := pairs.get((ids[h], rank))) is not None:
            heappush(heap, (r, h, ids[h], rank))
    return [i for i in ids if i >= 0]


@cache
def whole_words(path: str) -> dict[str, int]:
    """Words that are a piece by themselves though merges do not lead there: they have that id."""
    return {p.decode(): i for p, i in load_ranks(path).items() if merge_long(p, path) != [i] and p.decode(errors="ignore").encode() == p}


def ids_of(word: Column, path: str, ranks: Column) -> Column:
    """Ids of a word: the fold, but for ``whole_words``."""
    whole = {w: [i] for w, i in whole_words(path).items()}
    folded = fold_word(word, ranks)
    return F.coalesce(F.try_element_at(_constant(whole, "map<string,array<int>>"), word), folded) if whole else folded


def frequent_words(blocks: DataFrame, most: int) -> DataFrame:
    """Words of all blocks that are the most frequent: as many whole classes of counts as ``most`` allows."""
    each = blocks.select(F.inline(F.arrays_zip("words", "counts"))).filter(F.octet_length("words") <= LONG_WORD)
    counts = each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n")).filter("n > 1")
    level = F.floor(F.log2("n") * 16).cast("int")  # at most 16 * 63 classes
    counts = stored(counts.select("word", level.alias("level")), "bpe-words")
    least, held = 0, 0
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            least = r["level"] + 1
            break
    return counts.filter(F.col("level") >= least).select("word")


class Known:
    """The folded frequent words: word i has the ids ids[bounds[i]:bounds[i + 1]]."""

    def __init__(self, table: pa.Table) -> None:
        lists = table.column("ids").combine_chunks()
        self.words = table.column("word").combine_chunks()
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        self.ids = lists.values.to_numpy().astype(np.uint16)


def known_words(blocks: DataFrame, ranks_path: str, most: int) -> Known:
    often = frequent_words(blocks, most).repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism)
    folded = often.select("word", let(rank_map(ranks_path), lambda r: ids_of(F.col("word"), ranks_path, r)).alias("ids"))
    return Known(folded.toArrow())  # ``most`` rows at most


class _Numbers(dict):
    """Numbers of words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


#: Fixed value: a pattern whose matches never reach over a blank or line feed that follows no white space.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Units that are one match of it: letters, after a blank or not.
PLAIN = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿА-я]+\z"


def _matcher(pattern: str):
    """``pattern`` where \\s is white space by Unicode's property."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def word_numbers(texts: pa.Array, pattern: str, numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of the words of texts.  Distinct units of texts are matched once where the pattern allows it."""
    find = _matcher(pattern)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pattern != CUT_PATTERN:
        own = [list(map(numbers.__getitem__, find(t))) for t in texts.to_pylist()]
        return np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.array(list(chain.from_iterable(own)), np.int32)
    units, index, at, whole = cut(texts, spaced=True)
    plain = pc.match_substring_regex(pa.array(units, pa.large_string()), PLAIN).to_numpy(zero_copy_only=False)
    found = [[u] if p else find(u) for u, p in zip(units, plain.tolist())]
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size)
    pool = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int32, ends[-1])
    offsets, out = laid_out(pool, ends - size, size, index, at)
    if not len(whole):
        return offsets, out
    return spliced(offsets, out, whole, [list(map(numbers.__getitem__, find(t))) for t in texts.take(pa.array(whole)).to_pylist()])


_IDS, _SIZES, _BYTES, _WORDS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())


def word_blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """Blocks of documents: doc_ids, sizes (words of each), numbers (of all words), the block's distinct words and their counts."""
    schema = pa.schema([("doc_ids", _IDS), ("sizes", _SIZES), ("numbers", _BYTES), ("words", _WORDS), ("counts", _IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column("text"), BLOCK_BYTES):
                words = _Numbers()
                offsets, found = word_numbers(batch.column("text").slice(low, high - low), pattern, words)
                columns = [
                    batch.column("doc_id").slice(low, high - low).to_pylist(),
                    np.diff(offsets),
                    found.astype("<i4").tobytes(),
                    list(words),
                    np.bincount(found, minlength=len(words)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, schema.types)], schema=schema)

    made = documents(docs).mapInArrow(run, "doc_ids array<long>, sizes array<int>, numbers binary, words array<string>, counts array<long>")
    with arrow_rows(docs.sparkSession, 2500):
        return stored(made, "bpe-blocks", compression="zstd")


def _with_rare(known: Known):
    """``slots``: each word's number among the known ones, or -1 - its number among the ``rare``, which are not known."""
    schema = pa.schema([("doc_ids", _IDS), ("sizes", _SIZES), ("numbers", _BYTES), ("slots", _BYTES), ("rare", _WORDS)])

    table = known.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten()
            # One look for all blocks of the batch: the table is hashed anew each time, which takes no lasting memory.
            all_slots = pc.fill_null(pc.index_in(flat, value_set=table), -1).to_numpy()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            for i, (low, high) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                slots = all_slots[low:high].astype("<i4")
                missed = np.flatnonzero(slots < 0)
                slots[missed] = -1 - np.arange(len(missed))
                rare = pa.ListArray.from_arrays(pa.array([0, len(missed)], pa.int32()), flat.take(pa.array(low + missed)))
                same = [batch.column(c).slice(i, 1) for c in ("doc_ids", "sizes", "numbers")]
                columns = [*same, pa.array([slots.tobytes()], _BYTES), rare]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _together(ranks_path: str, known: Known, rows: Callable, names: list[str]):
    """Blocks whose rare words are folded to rows of documents; ``rows(offsets, ids)`` gives the columns."""
    ids, bounds = known.ids, known.bounds  # the words stay behind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                folded = batch.column("folded")[i].values
                if folded.null_count:  # long words come without ids
                    words = batch.column("rare")[i].values.to_pylist()
                    folded = pa.array([merge_long(w.encode(), ranks_path) if x is None else x for w, x in zip(words, folded.to_pylist())], folded.type)
                pool = np.concatenate([ids, folded.flatten().to_numpy(zero_copy_only=False).astype(np.uint16)])
                more = pc.list_value_length(folded).to_numpy(zero_copy_only=False).astype(np.int64)
                begins = np.concatenate([bounds, bounds[-1] + np.cumsum(more)])
                slots = np.frombuffer(batch.column("slots")[i].as_py(), "<i4").astype(np.int64)
                slots = np.where(slots < 0, len(bounds) - 2 - slots, slots)
                numbers = np.frombuffer(batch.column("numbers")[i].as_py(), "<i4")
                at = np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy())])
                offsets, out = laid_out(pool, begins[slots], begins[slots + 1] - begins[slots], numbers, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, *rows(offsets, out)], names=["doc_id", *names])

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, kept: int, rows: Callable, schema: str) -> DataFrame:
    blocks = word_blocks(docs, pattern)
    known = known_words(blocks, ranks_path, kept)
    names = [f.split()[0] for f in schema.split(", ")]

    def fold_rare(ranks: Column) -> Column:
        return F.transform("rare", lambda w: F.when(F.octet_length(w) <= LONG_WORD, ids_of(w, ranks_path, ranks)))

    looked = blocks.drop("counts").mapInArrow(_with_rare(known), "doc_ids array<long>, sizes array<int>, numbers binary, slots binary, rare array<string>")
    folded = looked.withColumn("folded", let(rank_map(ranks_path), fold_rare))
    return folded.mapInArrow(_together(ranks_path, known, rows, names), f"doc_id long, {schema}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def rows(offsets: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    coded = _encoded(docs, ranks_path, pattern, kept, rows, "ids array<int>")
    with arrow_rows(docs.sparkSession, BATCH_BLOCKS):
        return stored(coded, "bpe-ids")


def decode(ids: Column, ranks_path: str) -> Column:
    """Bytes of an array of ids: their pieces in a row."""
    table = _constant([p.hex() for p in pieces_by_id(ranks_path)], "array<string>")
    return let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def rows(offsets: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        pieces = pieces_by_id(ranks_path)
        spans = list(zip(offsets.tolist(), offsets[1:].tolist()))
        raw = memoryview(ids.astype("<u4").tobytes())
        coded = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]
        decoded = [hashlib.sha256(b"".join(map(pieces.__getitem__, ids[a:b].tolist()))).hexdigest() for a, b in spans]
        return [pa.array(np.diff(offsets)), pa.array(coded), pa.array(decoded)]

    coded = _encoded(docs, ranks_path, pattern, kept, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    with arrow_rows(docs.sparkSession, BATCH_BLOCKS):
        return stored(coded, "bpe-digests")

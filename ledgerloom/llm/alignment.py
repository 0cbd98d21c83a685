"""Alignment of the tokens of two tokenizers over a corpus, by distinct segments.

A text, with a blank before it, is cut before every run of white space that
begins with a blank or line feed and follows another character.  Neither
vocabulary has a token over such a place, which is verified when the files are
read: the byte-level file ends a match there, and no piece of the other holds a
blank or line feed after another character.  So the tokens of a text are those
of its segments, and so are the groups and links of the two.

Blocks of documents (``BLOCK_BYTES`` of text) become their distinct segments and
the numbers of all segments in order.  The distinct segments of all blocks are
tokenised and aligned once; links are counted by id pair over the corpus, each
segment as often as it occurs.  The alignments of the segments that are in most
blocks (``KEPT`` at most, of ``KEPT_BYTES`` at most) are sent to every worker,
the others meet the blocks by a join, and each block composes its documents.
How many are sent changes the time, not the result.

Groups: a group ends where a token of either tokenizer ends at the same byte.
Links: the pairs of tokens whose bytes overlap.

Defined cases: a text that is null or empty, or that holds the piece file's own
mark for a blank (U+2581), has no tokens: zeros and ''; strings of special
tokens are plain text; rows that repeat are rows of their own and count each;
an empty table gives an empty result; a text without any blank is one segment;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, arrow_rows, documents, stored
from .tokens import slices

#: Text bytes of a block of documents, about; a longer document is a block by itself.
BLOCK_BYTES = 12_000_000
#: Segments that are encoded as one text.
RUN = 400
#: Frequent segments that every worker knows, at most, and the bytes of one.
KEPT = 200_000
KEPT_BYTES = 32
#: Frequent pairs of ids that every worker knows, at most.
KEPT_PAIRS = 3_000_000
HALF = (1 << 32) - 1
#: A pair of ids (a, b) is the number a * SHIFT + b.
SHIFT = 1 << 24
#: The piece file's mark for a blank.
MARK = "▁"
#: Separates segments while a text is cut.
CUT = "\x00"


@dataclass(frozen=True)
class Tokenizers:
    """The files: byte-level ids (A) and pieces (B)."""

    bytes_path: str
    pieces_path: str


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Alignment:
    """Of segments: tokens of A and B, groups, links; the groups as text; the pairs of all links in a row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, spec: Tokenizers) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(spec.bytes_path)
        self.left.encode_special_tokens = True
        self.right = SentencePieceProcessor(model_file=spec.pieces_path)
        letters = byte_letters()
        vocabulary = self.left.get_vocab(with_added_tokens=False)
        self.left_text = {i: bytes(letters[c] for c in p) for p, i in vocabulary.items() if all(c in letters for c in p)}
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        self.right_text = [
            bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self._verify(pieces)

    def _verify(self, pieces: list[str]) -> None:
        """That no token can reach over a cut, and that pieces are the text itself."""
        for i, p in enumerate(pieces):
            plain = p.replace(MARK, " ")
            if not self.right.is_control(i) and any(b in " \n" and not a.isspace() for a, b in zip(plain, plain[1:])):
                raise ValueError(f"the piece {p!r} reaches over a cut")
        probe = "  ﬁ á  ½\n b "
        if self.right.normalize(probe).replace(MARK, " ") not in (probe, " " + probe):
            raise ValueError("the piece file changes the text")
        probes = ["a  b\n c\r\n\t d's 1 2,　 e", "x \n y", "ab.   c"]
        for text in probes:
            whole = self.left.encode(text, add_special_tokens=False).ids
            if whole != [i for s in segments(text) for i in self.left.encode(s, add_special_tokens=False).ids]:
                raise ValueError("the byte-level file has tokens over a cut")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by A and B of a text that begins with a blank or line feed; B's library puts a blank before what it gets."""
        left = self.left.encode(text, add_special_tokens=False).ids
        if text == " ":
            return left, [self.right.piece_to_id(MARK)]  # the library gives no pieces for an empty text
        if text.startswith(" "):
            return left, self.right.encode(text[1:], num_threads=1)
        word = self.right.encode("a", num_threads=1)  # stands before the cut and is taken off again
        return left, self.right.encode("a" + text, num_threads=1)[len(word) :]

    def align(self, parts: list[str]) -> Alignment:
        """Segments at once: in a row they are a text whose tokens all end at the cuts, but for one that ends with white space."""
        if any(p[-1].isspace() for p in parts[:-1]):
            raise ValueError("only the last segment may end with white space")
        text = "".join(parts)
        raw = text.encode()
        a, b = self.encode(text)
        mine, theirs = [self.left_text[i] for i in a], [self.right_text[i] for i in b]
        if b"".join(mine) != raw or b"".join(theirs) != raw:
            raise ValueError(f"the tokens of {text[:80]!r} are not its bytes")
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        end_a = np.cumsum(np.fromiter(map(len, mine), np.int64, len(mine)))
        end_b = np.cumsum(np.fromiter(map(len, theirs), np.int64, len(theirs)))
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # the groups' ends
        steps = np.union1d(end_a, end_b)  # each stretch between two of them lies in one token of either side: a link
        stop_a, stop_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        if len(np.setdiff1d(ends, both)):
            raise ValueError("a token reaches over a cut")
        words_a, words_b = list(map(str, a)), list(map(str, b))
        at = zip([0, *stop_a.tolist()], stop_a.tolist(), [0, *stop_b.tolist()], stop_b.tolist())
        groups = [",".join(words_a[i:j]) + "|" + ",".join(words_b[k:m]) for i, j, k, m in at]
        last = np.searchsorted(both, ends, "right")
        texts = [";".join(groups[i:j]) for i, j in zip([0, *last.tolist()], last.tolist())]
        upto = [np.searchsorted(x, ends, "right") for x in (end_a, end_b, both, steps)]
        n_a, n_b, n_groups, n_links = (np.diff(x, prepend=0) for x in upto)
        pairs = np.array(a, np.int64)[np.searchsorted(end_a, steps)] * SHIFT + np.array(b, np.int64)[np.searchsorted(end_b, steps)]
        return Alignment(n_a, n_b, n_groups, n_links, texts, pairs)


@cache
def aligner(spec: Tokenizers) -> Aligner:
    return Aligner(spec)


def cut(texts: pa.Array) -> pa.Array:
    """Lists of the segments of texts (large strings without nulls): a cut before a blank or line feed after no white space."""
    marked = pc.replace_substring_regex(texts, r"([^\s\x0b\x1c-\x1f\x{85}\p{Z}])([ \n])", rf"\1{CUT}\2")
    return pc.split_pattern(marked, CUT)


def segments(text: str) -> list[str]:
    """The segments of one text, which may hold the mark of cuts."""
    return re.split(r"(?<=\S)(?=[ \n])", text)


_BYTES = pa.binary()
BLOCK = ("doc_ids", "sizes", "numbers", "segments", "counts")


def segment_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: block, doc_ids, sizes (segments of each), numbers (of all), the distinct segments and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column("text"), BLOCK_BYTES):
                texts = pc.fill_null(batch.column("text").slice(low, high - low).cast(pa.large_string()), "")
                none = pc.or_(pc.equal(texts, ""), pc.match_substring(texts, MARK))
                led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
                odd = pc.match_substring(led, CUT)
                lists = cut(pc.if_else(pc.or_(none, odd), pa.scalar("", pa.large_string()), led))
                flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).copy()
                gone = none.to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False) & ~gone):
                    own = segments(led[i].as_py())  # rare: the text has the mark of cuts in it
                    at = int(sizes[:i].sum())
                    flat = pa.concat_arrays([flat.slice(0, at), pa.array(own, pa.large_string()), flat.slice(at + 1)])
                    sizes[i] = len(own)
                if gone.any():
                    flat = flat.filter(pa.array(np.repeat(~gone, sizes)))
                    sizes[gone] = 0
                coded = flat.dictionary_encode()
                numbers = coded.indices.to_numpy(zero_copy_only=False)
                lists = [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(sizes.astype(np.int32)),
                    coded.dictionary.cast(pa.string()),
                    pa.array(np.bincount(numbers, minlength=len(coded.dictionary)).astype(np.int64)),
                ]
                ids, counts, parts, often = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
                raw = pa.array([packed(numbers)], _BYTES)
                yield pa.RecordBatch.from_arrays([ids, counts, raw, parts, often], names=list(BLOCK))

    made = documents(docs).mapInArrow(run, "doc_ids array<long>, sizes array<int>, numbers binary, segments array<string>, counts array<long>")
    with arrow_rows(docs.sparkSession, 2500):
        return stored(made.withColumn("block", F.monotonically_increasing_id()), "align-blocks", compression="zstd")


def aligned(parts: DataFrame, spec: Tokenizers) -> DataFrame:
    """``parts``: segment, n and blocks, distinct.  Adds n_a, n_b, n_groups, n_links, groups, and the pairs of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(spec)
        for batch in batches:
            if not len(batch):
                continue
            texts = batch.column("segment").to_pylist()
            odd = [i for i, t in enumerate(texts) if t[-1].isspace()]
            plain = np.setdiff1d(np.arange(len(texts)), odd)
            runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)] + [np.array([i]) for i in odd]
            order = np.concatenate(runs)
            made = [tools.align([texts[i] for i in r]) for r in runs]
            size = np.concatenate([m.n_links for m in made])
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            numbers = [pa.array(np.concatenate([getattr(m, c) for m in made]).astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
            links = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m.pairs for m in made])))
            kept = [batch.column(c).take(pa.array(order)) for c in ("segment", "n", "blocks")]
            columns = [*kept, *numbers, pa.array([g for m in made for g in m.groups], pa.string()), links]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "n", "blocks", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    schema = "segment string, n long, blocks long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>"
    return parts.mapInArrow(run, schema)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
OWN = ("segment", "blocks", "n_a", "n_b", "n_groups", "n_links", "key", "groups")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair (the ids as one number), count (links over the corpus), times (among distinct segments), best (whether it is the highest of its B id)."""
    each = found.select("n", F.explode("pairs").alias("pair"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("times"))
    counts = stored(counts.withColumn("b", F.col("pair") % SHIFT), "align-pairs", compression="zstd")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(highest), "b").select("pair", "count", "times", (F.col("count") == F.col("highest")).alias("best"))


def least_level(rows: DataFrame, by: str, most: int) -> int:
    """The least level of ``by`` (16 to each power of two, so at most 16 * 63) from which on there are ``most`` rows at most."""
    held = 0
    for r in sorted(rows.groupBy(level(by).alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            return r["level"] + 1
    return 0


def level(by: str) -> Column:
    return F.floor(F.log2(by) * 16).cast("int")


class Pairs:
    """The pairs of most segments with their counts, KEPT_PAIRS at most."""

    def __init__(self, pairs: DataFrame, most: int) -> None:
        least = least_level(pairs, "times", most)
        table = pairs.filter(level("times") >= least).select("pair", "count", "best").toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        self.pair, self.count, self.best = (table.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
        self.least = least  # the level from which on all are known

    def look(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, best) of pairs; zeros where one is not known."""
        if not len(self.pair):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        known = self.pair[at] == pairs
        return known, np.where(known, self.count[at], 0), known & self.best[at]


def scored(found: DataFrame, pairs: Broadcast[Pairs], rest: DataFrame | None) -> DataFrame:
    """The segments with n_best and count_sum instead of their pairs.

    Links of the pairs ``rest``, which are not known to every worker, meet their counts by a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            known, count, best = pairs.value.look(codes)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64) for x in (best, count)]
            more = pa.array(np.concatenate([[0], np.cumsum(~known)])[ends].astype(np.int32))
            columns = [*[batch.column(c) for c in OWN], *map(pa.array, sums), pa.ListArray.from_arrays(more, pa.array(codes[~known]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*OWN, "n_best", "count_sum", "more"])

    numbers = ", ".join(f"{n} long" for n in ("blocks", *NUMBERS[:4], "key"))
    looked = found.mapInArrow(run, f"segment string, {numbers}, groups string, n_best long, count_sum long, more array<long>")
    if rest is not None:
        each = looked.select("key", F.explode("more").alias("pair"))
        met = each.join(rest, "pair").groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("b"), F.sum("count").alias("c"))
        looked = looked.join(met, "key", "left")
        looked = looked.withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))})
    return looked.select("segment", "blocks", *NUMBERS, "groups")


class Known:
    """Segments that every worker knows, with their scores."""

    def __init__(self, table: pa.Table) -> None:
        self.segments = table.column("segment").combine_chunks()
        self.numbers = np.stack([table.column(n).to_numpy() for n in NUMBERS], 1) if len(table) else np.zeros((0, len(NUMBERS)), np.int64)
        self.groups = table.column("groups").to_pylist()

    def slots(self, segments: pa.Array) -> np.ndarray:
        """Each segment's place among the known ones, or -1."""
        return pc.fill_null(pc.index_in(segments, value_set=self.segments), -1).to_numpy(zero_copy_only=False)


def rare_rows(blocks: DataFrame, known: Broadcast[Known]) -> DataFrame:
    """block, number, segment of the segments of a block that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts in zip(batch.column("block"), batch.column("segments")):
                rare = np.flatnonzero(known.value.slots(parts.values) < 0)
                columns = [pa.array(np.full(len(rare), block.as_py())), pa.array(rare.astype(np.int32)), parts.values.take(pa.array(rare))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "number", "segment"])

    return blocks.select("block", "segments").mapInArrow(run, "block long, number int, segment string")


def slotted(blocks: DataFrame, known: Broadcast[Known]) -> DataFrame:
    """The blocks with the places of their segments among the known ones instead of the segments."""
    kept = ["block", "doc_ids", "sizes", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [packed(known.value.slots(parts.values) + 1) for parts in batch.column("segments")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(slots, _BYTES)], names=[*kept, "slots"])

    return blocks.select(*kept, "segments").mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, numbers binary, slots binary")


def composer(known: Broadcast[Known]):
    """A block and the scores of its rare segments to the rows of its documents."""

    def run(blocks: pa.Table, rare: pa.Table) -> pa.Table:
        slots = unpacked(blocks.column("slots")[0].as_py()) - 1
        values = np.zeros((len(slots), len(NUMBERS)), np.int64)
        often = np.flatnonzero(slots >= 0)
        values[often] = known.value.numbers[slots[often]]
        groups: list = [None] * len(slots)
        texts = known.value.groups
        for i in often.tolist():
            groups[i] = texts[slots[i]]
        if len(rare):
            at = rare.column("number").to_numpy()
            high, low = (rare.column(c).to_numpy() for c in ("tokens", "parts"))
            n_a, n_b, n_groups, n_best = high >> 32, high & HALF, low >> 32, low & HALF
            # A group of p and q tokens has p + q - 1 links, as each ends where the last token of both does.
            values[at] = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, rare.column("count_sum").to_numpy()], 1)
            for i, g in zip(at.tolist(), rare.column("groups").to_pylist()):
                groups[i] = g
        numbers = unpacked(blocks.column("numbers")[0].as_py())
        ends = np.concatenate([[0], np.cumsum(blocks.column("sizes")[0].values.to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(values[numbers, c])])[ends] for c in range(len(NUMBERS))]
        digests = []
        for low, high in zip(ends.tolist(), ends[1:].tolist()):
            text = ";".join(map(groups.__getitem__, numbers[low:high].tolist()))
            digests.append(hashlib.sha256(text.encode()).hexdigest() if high > low else "")
        columns = [blocks.column("doc_ids")[0].values, *[pa.array(np.diff(s)) for s in sums], pa.array(digests, pa.string())]
        return pa.table(columns, names=["doc_id", *NUMBERS, "groups_sha256"])

    return run


def folded(scores: DataFrame) -> DataFrame:
    """The scores with two numbers in one, as a segment has less than 2^31 tokens: most of what is sent are these rows."""
    two = lambda x, y: F.shiftleft(F.col(x), 32) + F.col(y)
    return scores.select("segment", two("n_a", "n_b").alias("tokens"), two("n_groups", "n_best").alias("parts"), "count_sum", "groups")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as their number and compressed bytes, those of one weight together."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    count = int.from_bytes(raw[:8], "little")
    planes = pa.Codec("zstd").decompress(raw[8:], 4 * count, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def align_documents(docs: DataFrame, spec: Tokenizers, kept: int = KEPT, kept_pairs: int = KEPT_PAIRS) -> DataFrame:
    """doc_id, the numbers of tokens, groups and links, n_best, count_sum and groups_sha256 of every document."""
    blocks = segment_blocks(docs)
    each = blocks.select(F.inline(F.arrays_zip("segments", "counts")))
    distinct = each.groupBy(F.col("segments").alias("segment")).agg(F.sum("counts").alias("n"), F.count(F.lit(1)).alias("blocks"))
    with arrow_rows(docs.sparkSession, 50 * RUN):
        found = stored(aligned(distinct, spec).withColumn("key", F.monotonically_increasing_id()), "align-found", compression="zstd")
    # Broadcast once for all passes: KEPT_PAIRS pairs and KEPT segments at most.
    spark, counts = docs.sparkSession, pair_counts(found)
    top = Pairs(counts, kept_pairs)
    other = counts.filter(level("times") < top.least) if top.least else None
    pairs = spark.sparkContext.broadcast(top)
    # Known to every worker: short segments of the most blocks.
    short = (F.octet_length("segment") <= KEPT_BYTES) & (F.col("blocks") > 1)
    least = least_level(found.filter(short), "blocks", kept)
    often = short & (level("blocks") >= least)
    known = spark.sparkContext.broadcast(Known(scored(found.filter(often), pairs, other).toArrow()))
    rest = found.filter(~often)
    total = rest.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    limit = max(1, int(total * HOT_SHARE))  # fewer than 1 / HOT_SHARE segments are in more blocks
    hot, cold = (folded(scored(rest.filter(x), pairs, other)) for x in (F.col("blocks") > limit, F.col("blocks") <= limit))
    rare = rare_rows(blocks, known)
    names = F.broadcast(rest.filter(F.col("blocks") > limit).select("segment"))
    met = rare.join(F.broadcast(hot), "segment").unionByName(rare.join(names, "segment", "left_anti").join(cold, "segment"))
    theirs = met.select(F.col("block").alias("b"), "number", "tokens", "parts", "count_sum", "groups")
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string"
    return slotted(blocks, known).groupBy("block").cogroup(theirs.groupBy("b")).applyInArrow(composer(known), schema)

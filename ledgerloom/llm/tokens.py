"""Vectorised tokenization of whole texts with the tokenizers library.

A text is cut into units at single blanks and line feeds, distinct units are
found by Arrow's dictionary encoding, only units that this Python worker has
not met are encoded, and the ids of all texts are gathered with NumPy.  A cut
is made only where the tokenizer's own pre-tokenization always ends a match,
so that the ids are those of the whole text; a text without that property (a
blank or line feed after other white space) is encoded in one piece.

Units are encoded many at a time, as one string in which a control character
between blanks divides them; the library ends a match at that character too.
Where a file lower-cases, the letters A to Z are lower-cased before units are
looked up and marks after letters are units of their own, so that fewer units
are distinct.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers; beyond, it forgets the later half (results do not depend on it).
CACHE_UNITS = 600_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 5_000_000
#: Units that are encoded as one string.
JOINED_UNITS = 400
#: Divides units; a unit that holds it is encoded by itself.
DIVIDER = "\x01"
#: A mark between a letter and a blank: a match ends before it.
MARK = r"([a-zß-öø-ÿа-я])([.,;:!?]) "
#: Stands before a unit that follows no white space; a text that holds it stays whole.
CLOSE = "\x02"
#: White space of any kind before a blank or line feed.
IRREGULAR = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]|\x02"


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer file.

    ``spaced``: a blank belongs to the word after it (byte-level files); else
    white space is dropped and letters are lower-cased.
    """

    path: str
    spaced: bool


class Encoder:
    """Encodes slices of texts; one per worker and tokenizer."""

    _made: dict[TokenizerSpec, Encoder] = {}

    def __init__(self, spec: TokenizerSpec) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(spec.path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spec.spaced
        self.divider = " " + DIVIDER + ("" if spec.spaced else " ")
        self.divider_ids = self._ids([self.divider])[0]
        self.known: dict[str, int] = {}  # unit: its number
        self.pool = np.zeros(1 << 16, np.int32)  # ids of all units
        self.bounds = np.zeros(1 << 14, np.int64)  # unit n has pool[bounds[n]:bounds[n + 1]]

    @classmethod
    def of(cls, spec: TokenizerSpec) -> Encoder:
        if spec not in cls._made:
            cls._made[spec] = cls(spec)
        return cls._made[spec]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of units that follow white space and hold no divider."""
        texts = [self.divider.join(units[at : at + JOINED_UNITS]) for at in range(0, len(units), JOINED_UNITS)]
        coded = self._ids(texts)
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, ends[-1])
        width = len(self.divider_ids)
        found = np.flatnonzero(ids == self.divider_ids[-1])  # no other text has this id
        stops = np.sort(np.concatenate([found - (width - 1), ends]))
        starts = np.sort(np.concatenate([found + 1, [0], ends[:-1]]))
        if len(stops) != len(units):
            raise RuntimeError("a unit was not divided")
        mask = np.ones(len(ids), bool)
        for back in range(width):
            mask[found - back] = False
        return ids[mask], stops - starts

    def _apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of units, each encoded by itself."""
        coded = self._ids(units)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int32, sizes.sum()), sizes

    def _learn(self, units: list[str]) -> None:
        """Number ``units``, none of them known; those that may be joined go first."""
        begin = (" ", "\n") if self.spaced else ""
        joint = [u for u in units if u.startswith(begin) and DIVIDER not in u]
        apart = [u for u in units if not u.startswith(begin) or DIVIDER in u]
        parts = [f(u) for f, u in ((self._joined, joint), (self._apart, apart)) if u]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        old, new = len(self.known), len(self.known) + len(units)
        if new + 1 > len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * (new + 1))
        ends = self.bounds[old] + np.cumsum(sizes)
        if ends[-1] > len(self.pool):
            self.pool = np.resize(self.pool, 2 * ends[-1])
        self.pool[self.bounds[old] : ends[-1]] = ids
        self.bounds[old + 1 : new + 1] = ends
        self.known.update(zip(chain(joint, apart), range(old, new)))

    def _numbers(self, units: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = list(dict.fromkeys(units[i] for i in np.flatnonzero(out < 0)))
        if len(self.known) + len(new) > CACHE_UNITS and self.known and new:
            # Frequent units are met first, so the first half stays.
            self.known = dict(islice(self.known.items(), CACHE_UNITS // 2))  # numbers go without gaps
            out = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
            new = list(dict.fromkeys(units[i] for i in np.flatnonzero(out < 0)))
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        missed = np.flatnonzero(out < 0)
        out[missed] = [self.known[units[i]] for i in missed]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        units, index, at, whole = cut(texts, self.spaced)
        number = self._numbers(units)
        begin = self.bounds[number]
        offsets, ids = laid_out(self.pool, begin, self.bounds[number + 1] - begin, index, at)
        if not len(whole):
            return offsets, ids
        return spliced(offsets, ids, whole, self._ids(texts.take(pa.array(whole)).to_pylist()))


def cut(texts: pa.Array, spaced: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(units, index, at, whole) of texts without nulls.

    Text i has the units index[at[i]:at[i + 1]], but for the texts ``whole``, which have to stay in one piece.
    """
    whole = np.zeros(0, np.int64)
    if spaced:
        odd = pc.match_substring_regex(texts, IRREGULAR)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
    # Units begin with their white space: a line feed stays, the blank that split_pattern eats is put back.
    flat = pc.replace_substring(texts, "\n", " \n" if spaced else " ")
    if not spaced:
        flat = pc.ascii_lower(flat)  # a fresh array: on a slice this function returns other bytes
    flat = pc.replace_substring_regex(flat, MARK, rf"\1 {CLOSE if spaced else ''}\2 ")
    lists = pc.split_pattern(flat, " ")
    coded = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = coded.dictionary
    if not spaced:
        return values.to_pylist(), index, at, whole
    count, first, text = len(values), at[:-1], pa.large_string()
    led = pc.binary_join_element_wise(pa.scalar(" ", text), values, pa.scalar("", text))
    blank = pc.if_else(pc.starts_with(values, "\n"), values, led)
    blank = pc.if_else(pc.starts_with(values, CLOSE), pc.utf8_slice_codeunits(values, 1), blank)
    bare, place = np.unique(index[first], return_inverse=True)
    index[first] = count + place
    return blank.to_pylist() + values.take(pa.array(bare)).to_pylist(), index, at, whole


def laid_out(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, entries) of texts whose unit ``index[k]`` has the entries pool[begin:begin + size] of that unit."""
    lengths = size[index]
    ends = np.cumsum(lengths)
    entries = pool[np.repeat(begin[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return np.concatenate(([0], ends))[at], entries


def spliced(offsets: np.ndarray, entries: np.ndarray, whole: np.ndarray, own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same with the entries ``own`` of the texts ``whole``, which have none yet or no valid ones."""
    pieces: list = [entries[a:b] for a, b in zip(offsets, offsets[1:])]
    for i, ids in zip(whole, own):
        pieces[i] = np.array(ids, entries.dtype)
    return np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), np.concatenate(pieces)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, stop) of runs of texts of about ``most`` bytes at most, or a single longer one."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, s in enumerate(size):
        if held and held + s > most:
            yield start, i
            start, held = i, 0
        held += s
    if len(size):
        yield start, len(size)


def end_with(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    mask = np.ones(len(out), bool)
    new = offsets + np.arange(n + 1)
    mask[new[1:] - 1] = False
    out[mask] = ids
    return new, out

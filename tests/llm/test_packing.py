import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.tokens import TokenizerSpec

from .conftest import TEXTS, strip

SPEC = TokenizerSpec(P.path("byte_bpe_50k.json"), spaced=True)
COUNTS = st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1, max_size=8)


def fewest(lengths, capacity):
    """Least number of bins by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[i]}):
            k = rooms.index(r)
            place(i + 1, rooms[:k] + [r - lengths[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best[0]


@given(COUNTS)
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once_without_gaps(counts):
    fill, ranks = defaultdict(list), defaultdict(list)
    for s in packing.plan(counts, 20):
        for rank in range(s["low"], s["high"]):
            ranks[s["length"]].append(rank)
            fill[s["first"] + (rank - s["low"]) // s["per"]].append((s["at"] + (rank - s["low"]) % s["per"] * s["length"], s["length"]))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(fill) == list(range(len(fill)))
    for pieces in fill.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= 20


@given(st.dictionaries(st.integers(1, 10), st.integers(1, 2), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_what_dominance_fixes_belongs_to_an_optimum(counts):
    lengths = [k for k, n in counts.items() for _ in range(n)]
    fixed, left = packing.reduce_by_dominance(counts, 10)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert sum(times for times, _ in fixed) + fewest(rest, 10) == fewest(lengths, 10)


def test_pieces_have_the_tokenizers_ids(docs, clashing):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = packing.pack_documents(docs, SPEC).collect()
    assert strip(r[:5] for r in rows) == sorted(want, key=repr)
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= 1024
    assert len(packing.pack_documents(clashing, SPEC).collect()) == len(rows)


def test_sequences_join_the_pieces(docs, spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import stored

    pieces = stored(packing.encode_pieces(docs, SPEC), "t")
    packed = packing.pack(pieces).collect()
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(pieces)).collect()}
    want = defaultdict(bytes)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += bytes(r.ids)
    assert made == dict(want)
    assert pieces.select(F.sum("length")).first()[0] == sum(len(v) for v in made.values()) // 4


def test_empty(nothing):
    assert packing.pack_documents(nothing, SPEC).collect() == []


def test_few_bins_on_dense_lengths():
    counts = {n: 30 + n % 7 for n in range(1, 1025)}
    bins = 1 + max(s["first"] + (s["high"] - s["low"] - 1) // s["per"] for s in packing.plan(counts))
    assert bins <= 1.001 * sum(k * n for k, n in counts.items()) / 1024 + 1

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import queries

from . import plain_pii
from .test_quality_rules import RULES_BY_HAND, slow_base, slow_features, slow_posteriors
from .test_simhash import slow_components, slow_fingerprint


def test_stages_run_on_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = corpus_pipeline.stored(docs, "t")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == set(ids)


def test_stages_accept_empty_and_null_documents(spark, docs, nothing, sf_dir):
    for start in (docs, nothing):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.stored(stage(spark, now, sf_dir), "t")


def test_every_query_is_named():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_whole_run_matches_brute_force(spark, sf_dir):
    """All stages in plain Python: which documents are left, and the ids of every piece of them."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    votes = [[vote(f) for vote in RULES_BY_HAND.values()] for f in (slow_features(t) for _, t in rows)]
    rows = [r for r, p in zip(rows, slow_posteriors(votes)) if p >= 0.5 and not slow_base(r[1])[-1]]
    last = {}
    for i, t in sorted(rows):
        last[t or ""] = (i, t)
    rows = sorted(last.values())
    roots, seen = slow_components([slow_fingerprint(t) for _, t in rows]), set()
    rows = [r for r, root in zip(rows, roots) if not (root in seen or seen.add(root))]  # in the order of doc_id
    private = plain_pii.replace(rows, queries.surrogate_key(spark))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for i, (text, _) in private.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    # The bins are few: best fit decreasing on the same lengths needs no less.
    rooms = []
    for n in sorted((r.length for r in out), reverse=True):
        fit = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if fit is None:
            rooms.append(1024 - n)
        else:
            rooms[fit] -= n
    assert len(held) <= len(rooms)

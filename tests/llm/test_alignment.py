import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment

from .conftest import TEXTS, strip

FILES = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def slow(rows):
    """Whole texts, each by both libraries, token by token."""
    left = Tokenizer.from_file(FILES.bytes_path)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=FILES.pieces_path)
    letters = alignment.byte_letters()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found, counts = [], Counter()
    for doc, text in rows:
        coded = left.encode(" " + (text or ""), add_special_tokens=False)
        a = coded.ids  # a copy each time it is asked for
        b = right.encode(text or "")
        mine = [bytes(letters[c] for c in t) for t in coded.tokens]
        pieces = [right.id_to_piece(i) for i in b]
        theirs = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(mine) != raw or b"".join(theirs) != raw:
            found.append((doc, None))
            continue
        x, y = spans(mine), spans(theirs)
        links, low = [], 0
        for i, (s, e) in enumerate(x):
            while y[low][1] <= s:
                low += 1
            j = low
            while j < len(y) and y[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in x} & {e for _, e in y}):
            own = [[], []]
            while i < len(x) and x[i][1] <= end:
                own[0].append(str(a[i]))
                i += 1
            while j < len(y) and y[j][1] <= end:
                own[1].append(str(b[j]))
                j += 1
            groups.append("|".join(",".join(o) for o in own))
        counts.update(links)
        found.append((doc, (len(x), len(y), groups, links)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, v in found:
        if v is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = v
        best = sum(counts[k] == highest[k[1]] for k in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return strip(alignment.align_documents(df, FILES).collect())


def test_matches_whole_texts(docs, clashing, nothing):
    assert run(docs) == slow(TEXTS)
    assert run(clashing) == slow(TEXTS)
    assert run(nothing) == []


def test_odd_texts(spark):
    rows = list(
        enumerate(
            [
                " ", "  ", "\n", "\n\n a", "a\n", "a \n", "a  b", "a\tb", "a\r\n b;\r\nc", "x▁y", "nul\x00 in the  text\x00\nmore \x00", "it's 12 345", "　wide　 blank",
                "<0x0A> <s> <unk> </s> <|endoftext|>", "é é", "﻿mark", "🙂🙂 🙂‍🙂", "\x85 \x1c a", "tail   ", "a  b  c", "word" * 2000, " lead", "\n lead",
            ]
        )
    )
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df) == slow(rows)


def test_only_texts_without_tokens(spark):
    rows = [(1, None), (2, ""), (3, "▁")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_random_texts_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    draw = random.Random(5)
    signs = ["a", "b", "Ab", "ing", " ", " ", "  ", "\n", "\r", "\t", ".", ";", "1", "é", "漢", " ", "​", "'s", "-", "ﬁ"]
    rows = [(i, "".join(draw.choices(signs, k=draw.randrange(60)))) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]  # copies
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), slow(rows)
    for kept, pairs in ((0, 0), (20, 30), (10**6, 10**6)):  # segments and pairs that all workers know
        assert strip(alignment.align_documents(df, FILES, kept, pairs).collect()) == want


def test_cuts_keep_the_text():
    for text in ("a  b\n c", "x\x00 y", " \n", "", "one"):
        assert "".join(alignment.segments(text)) == text


def test_a_vocabulary_over_cuts_is_refused():
    tools = alignment.aligner(FILES)
    pieces = [tools.right.id_to_piece(i) for i in range(100)]
    with pytest.raises(ValueError, match="reaches over a cut"):
        tools._verify([*pieces, "in▁the"])


def test_the_query_is_the_plain_result(spark, sf_dir):
    from ledgerloom.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    assert strip(QUERIES["op13_segment_alignment"](spark, sf_dir).collect()) == slow([tuple(r) for r in table.collect()])

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from ledgerloom.llm import byte_bpe, token_orc
from ledgerloom.llm.common import scratch_path
from ledgerloom.llm.tokens import Encoder, TokenizerSpec

from .conftest import TEXTS, strip

ODD = ["", None, "a\x02b, c", "Word, next; end. x? y! z: w", "\x01 a \x01b", "  a  b\n\n c \n d\t e \xa0 f g's  ", " lead", "\nlead", "trail ", "trail\n", "x \n y", "'s 't''s", "\x1c a\x1cb \x85 c", "Σ ΑΣ ΑΣ. ﬁ", " ", "\n", " \n"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts():
    texts = ODD + [t for _, t in TEXTS]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        whole = library(name)
        offsets, ids = Encoder(TokenizerSpec(P.path(name), spaced)).encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


def test_cache_limit_changes_nothing(monkeypatch):
    import ledgerloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_UNITS", 5)
    encoder = Encoder(TokenizerSpec(P.path("byte_bpe_50k.json"), True))
    whole = library("byte_bpe_50k.json")
    for text in ("a b c d", "e f g h i j k l", "a b c"):
        offsets, ids = encoder.encode(pa.array([text]))
        assert list(ids) == whole(text)


def test_a_unit_at_the_start_and_within():
    """The same unit may come from the start of one text and the middle of another."""
    encoder = Encoder(TokenizerSpec(P.path("byte_bpe_50k.json"), True))
    whole = library("byte_bpe_50k.json")
    for texts in (["\nlead x", "a\nlead", "last"], ["new words", "last", "\nlead"], ["more of them last"]):
        offsets, ids = encoder.encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


def test_orc_round_trip(spark, docs, clashing, nothing):
    spec = TokenizerSpec(P.path("word_bpe_49k.json"), spaced=False)
    whole = library("word_bpe_49k.json")
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(t) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert strip(token_orc.encode_to_orc(docs, spec).collect()) == sorted(want, key=repr)
    assert strip(token_orc.encode_to_orc(clashing, spec).collect()) == sorted(want, key=repr)
    assert token_orc.encode_to_orc(nothing, spec).collect() == []


def test_orc_files_are_indexed(spark, docs):
    from pyarrow import orc

    path = scratch_path(spark, "t")
    token_orc.write_token_orc(docs, path, TokenizerSpec(P.path("word_bpe_49k.json"), spaced=False))
    files = [f for f in spark.read.orc(path).inputFiles()]
    read = orc.ORCFile(files[0].removeprefix("file://"))
    assert read.row_index_stride == token_orc.INDEX_STRIDE
    assert token_orc.read_token_orc(spark, path).filter("doc_id = 5").select("doc_id").collect()[0].doc_id == 5


def test_byte_bpe_is_that_of_the_library(docs, clashing, nothing, spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})

    def want(rows):
        out = []
        for i, t in rows:
            ids = encoding.encode_ordinary(t or "")
            out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        return sorted(out, key=repr)

    assert strip(byte_bpe.round_trip(docs, path, P.PATTERN).collect()) == want(TEXTS)
    assert strip(byte_bpe.round_trip(clashing, path, P.PATTERN).collect()) == want(TEXTS)
    assert byte_bpe.round_trip(nothing, path, P.PATTERN).collect() == []
    odd = list(enumerate([*ODD, "a" * 3000, "äöü" * 200, "xyzzy" * 400]))
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert strip(byte_bpe.round_trip(df, path, P.PATTERN).collect()) == want(odd)

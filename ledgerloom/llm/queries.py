"""Driver queries of the training-data operators, and SQL where it can express them.

Each query applies one operator with its production parameters to the whole
``documents`` or ``embeddings`` table and returns the whole result.
"""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, exact_dedup, line_dedup, mtree, packing, pii, quality_rules, sharding, simhash, token_orc, vector_codes, weak_classifier
from .common import read_documents
from .tokens import TokenizerSpec


def byte_tokenizer() -> TokenizerSpec:
    return TokenizerSpec(public_tokenizers.path("byte_bpe_50k.json"), spaced=True)


def word_tokenizer() -> TokenizerSpec:
    return TokenizerSpec(public_tokenizers.path("word_bpe_49k.json"), spaced=False)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), byte_tokenizer())


def op2_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_documents(spark, sf_dir))
    base = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", "n_words", *base, "base_failed", "kept", "posterior")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_to_orc(read_documents(spark, sf_dir), word_tokenizer())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


_drawn_keys: dict[str, str] = {}


def surrogate_key(spark: SparkSession) -> str:
    """The secret key of surrogates: the session's setting.

    Without one a session on this machine takes a key for trials, which is no secret; on a cluster a secret is drawn once
    an application, so that its queries agree on surrogates and no one can tell them.  Only a key that is set gives the
    same surrogates in the next application.
    """
    key = spark.conf.get("spark.ledgerloom.surrogateKey", "")
    if not key and not spark.sparkContext.master.startswith("local"):
        key = _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key or "trial"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return pii.replace_entities(docs, surrogate_key(spark)).select("doc_id", "text", "n_entities")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_documents(spark, sf_dir))


def op9_weak_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_classifier.classify(read_documents(spark, sf_dir))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(read_embeddings(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_embeddings(spark, sf_dir))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align_documents(read_documents(spark, sf_dir), files)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_weak_quality_rules": op2_weak_quality_rules,
    "op3_token_orc": op3_token_orc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_line_dedup": op7_line_dedup,
    "op8_hypergeometric_sharding": op8_hypergeometric_sharding,
    "op9_weak_classifier": op9_weak_classifier,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_mtree_search": op11_mtree_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_segment_alignment": op13_segment_alignment,
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op11_mtree_search": mtree.ORACLE_SQL,
    "op12_vector_codes": vector_codes.oracle_sql(),
}

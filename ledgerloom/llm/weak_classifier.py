"""Quality classifier trained on weak labels.

Overlapping heuristic labellers vote on every document or abstain.  Expectation
maximisation over the counts of vote patterns (all documents) estimates their
accuracies; the posterior is a soft label.  A linear scorer over hashed byte
trigrams learns the soft labels of a bounded sample (``TRAIN_ROWS`` documents,
those with the least keyed hash of doc_id) and scores every document by its
whole text.

Defined cases: a null or empty text has no trigram, so its score is that of
the bias; an empty table gives an empty result; repeated rows get equal
scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, stored
from .quality_rules import HELD, RULES, Rule, feature_struct, fit_votes, posterior, votes

#: Documents that the scorer is fitted on, at most.
TRAIN_ROWS = 8192
BITS = 14
STEPS = 400
RATE = 8.0
DECAY = 2e-5
SEED = 7
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20

#: The quality rules but for that of length, since a short text may be good, and two more.
LABELLERS = (
    *[r for r in RULES if r.name != "length"],
    Rule("dense_symbols", "n_symbols + n_shouts >= n_words", "n_symbols + n_shouts = 0"),
    Rule("long_lines", "n_lines >= 5 AND n_words < n_lines * 2", "n_lines >= 1 AND n_words >= n_lines * 5"),
)


def trigram_buckets(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, scaled to length one by square roots."""
    counts = np.zeros(1 << BITS, np.float64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-(trigram_buckets(text) @ self.weights + self.bias))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Scorer:
    """Logistic regression on soft labels by full gradient steps with momentum; ``rows`` are (buckets, values)."""
    if not rows:
        return Scorer(np.zeros(1 << BITS), 0.0)
    size = np.array([len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), size)
    weights, speed, bias, drift = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for _ in range(STEPS):
        odds = np.bincount(row, value * weights[index], len(rows)) + bias
        error = 1 / (1 + np.exp(-odds)) - labels
        slope = np.bincount(index, value * error[row], 1 << BITS) / len(rows) + DECAY * weights
        speed, drift = 0.9 * speed - RATE * slope, 0.9 * drift - RATE * error.mean()
        weights, bias = weights + speed, bias + drift
    return Scorer(weights, float(bias))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, values = [], []
        for text in batch.column("text").cast(pa.large_binary()):
            dense = trigram_buckets(text.as_py() or b"")
            at.append(np.flatnonzero(dense).astype(np.int32))
            values.append(dense[at[-1]].astype(np.float32))
        columns = [batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "at", "values"])


def classify(docs: DataFrame, labellers: tuple[Rule, ...] = LABELLERS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score and kept (score of one half or more) of every document."""
    spark = docs.sparkSession
    names = [r.name for r in labellers]
    base = documents(docs)
    measured = base.select("doc_id", F.xxhash64("text").alias("th"), feature_struct(F.col("text")).alias(HELD))
    cast = stored(measured.select("doc_id", "th", *votes(labellers)), "weak-votes")
    model = fit_votes(cast, names)
    labelled = cast.select("doc_id", "th", posterior(model, [F.col(n) for n in names]).alias("label"))
    chosen = labelled.dropDuplicates(["doc_id", "th"]).orderBy(F.xxhash64(F.lit(SEED), "doc_id", "th"), "doc_id", "th").limit(train_rows)
    chosen = stored(chosen, "weak-sample").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "label")
    with arrow_rows(spark, 1000):
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
        sample = base.join(F.broadcast(chosen), same).dropDuplicates(["__id", "__th"]).select("label", "text")
        rows = sample.mapInArrow(_sparse, "label double, at array<int>, values array<float>").toArrow()
    pairs = [
        (np.asarray(a, np.int32), np.asarray(v, np.float64))
        for a, v in zip(rows.column("at").to_pylist(), rows.column("values").to_pylist())
    ]
    order = sorted(range(len(pairs)), key=lambda i: (rows.column("label")[i].as_py(), len(pairs[i][0]), pairs[i][0].tolist()[:8]))
    labels = np.array([rows.column("label")[i].as_py() for i in order])
    scorer = fit_scorer([pairs[i] for i in order], labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(t.as_py() or b"") for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    with arrow_rows(spark, 1000):
        scored = stored(base.mapInArrow(run, "doc_id long, score double"), "weak-scores")
    return scored.withColumn("kept", F.col("score") >= 0.5)

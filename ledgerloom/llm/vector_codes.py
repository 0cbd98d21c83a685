"""Vectors as codes of integer codebooks.

Vectors are cut into ``PARTS`` equal consecutive parts.  The codebook of a part
position starts as that part of the rows with the least vec_ids.  In each round
every part goes to the nearest entry of its codebook (squared Euclidean
distance, ties to the lower index), and each entry becomes the floor of the mean
of its parts; an entry without parts stays.  At last parts are assigned again.

Codebooks are of fixed size (``ENTRIES`` of a vector's length), so they go to
every task as they are.  A task takes Arrow batches: all distances of a batch
come from squared lengths and one product of integer matrices, and the first
least one is the code.  A task keeps one sum and one count an entry, whatever it
reads; these are merged by a grouped shuffle.  All arithmetic is in 64-bit
integers; components beyond ``MOST`` after scaling, for which sums of distances
might not fit, are an error.

Defined cases: rows whose vector is null or holds null or non-finite components
go; shorter vectors are filled up with zeros to the longest, and that to a
multiple of the parts; fewer than ``ENTRIES`` rows make as many entries; rows of
one vec_id follow in the order of their vectors, a null vec_id comes last;
repeated rows stay and count each; null labels are one label; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, keyed_join, stored
from .vectors import integers, matrix, padded

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components beyond would leave too little room for sums of squared distances.
MOST = 1 << 24
#: Vectors in an Arrow batch: its distances to a codebook take 8 * 256 times as many bytes.
BATCH_ROWS = 8192


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the first of equals, and its squared distance) for rows of int64."""
    # x.x is the same for all entries of a row: it is added to the least only.
    rest = np.einsum("ij,ij->i", book, book)[None] - 2 * (part @ book.T)
    at = rest.argmin(1)
    return at, rest[np.arange(len(part)), at] + np.einsum("ij,ij->i", part, part)


def parts_of(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    v = matrix(batch.column("v"), size)
    width = size // PARTS
    return [np.ascontiguousarray(v[:, p * width : (p + 1) * width]) for p in range(PARTS)]


def first_books(rows: DataFrame, size: int) -> np.ndarray:
    """Codebooks (part, entry, component) of the rows with the least vec_ids."""
    least = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).toArrow()  # ENTRIES rows
    v = matrix(least.column("v").combine_chunks(), size)
    return np.ascontiguousarray(v.reshape(len(v), PARTS, size // PARTS).transpose(1, 0, 2))


def moved(rows: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after a round."""
    width = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if not len(batch):
                continue
            for p, part in enumerate(parts_of(batch, size)):
                at, _ = nearest(part, books[p])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                sums[p, used] += np.add.reduceat(part[order], first, axis=0)
                counts[p] += np.bincount(at, minlength=len(counts[p]))
        p, entry = np.nonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, entry].ravel()), width).cast(pa.list_(pa.int64()))
        columns = [pa.array(p.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[p, entry]), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    made = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    merged = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    got = merged.toArrow()  # PARTS * ENTRIES rows at most
    out = books.copy()
    total = matrix(got.column("sums").combine_chunks(), width) // got.column("n").to_numpy()[:, None]
    out[got.column("part").to_numpy(), got.column("entry").to_numpy()] = total
    return out


def fitted(rows: DataFrame, size: int, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, size)
    for _ in range(rounds):
        books = moved(rows, books, size)
    return books


def coded(rows: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """The rows with code and error instead of v."""
    kept = [f for f in rows.schema.fields if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = [nearest(part, books[p]) for p, part in enumerate(parts_of(batch, size))]
            raw = np.stack([at for at, _ in found], 1).astype(np.uint8).tobytes().hex()
            code = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(code), pa.array(sum(e for _, e in found))]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "code", "error"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{types}, code string, error long")


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    rows = integers(vectors, SCALE, MOST, "label")
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    size = max(PARTS, -(-longest // PARTS) * PARTS)
    rows = stored(rows.select("vec_id", padded(F.col("v"), size).alias("v"), "label"), "codes-rows")
    with arrow_rows(rows.sparkSession, BATCH_ROWS):
        books = fitted(rows, size)
        # A label as a key: whether there is one, and its text.
        label = F.col("label").cast("string")
        keyed = rows.select("vec_id", label.isNull().alias("no_label"), F.coalesce(label, F.lit("")).alias("label"), "v")
        done = stored(coded(keyed, books, size), "codes")
    keys = ["no_label", "label"]
    by_label = stored(done.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    total = done.count()
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    out = keyed_join(done, by_label, keys, "n", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL: a chain of tables, two for each round."""

    def assigned(n: int) -> str:
        return f"""
        a{n} AS MATERIALIZED (
            SELECT r, part, p, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, min(d) AS d
            FROM (SELECT parts.r, parts.part, parts.p, entry,
                         CAST(list_sum([(parts.p[i] - c[i]) * (parts.p[i] - c[i]) for i in range(1, len(c) + 1)]) AS BIGINT) AS d
                  FROM parts JOIN b{n} ON parts.part = b{n}.part)
            GROUP BY r, part, p)"""

    def next_books(n: int) -> str:
        return f"""
        b{n + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.c, b.c) AS c
            FROM b{n} AS b LEFT JOIN (
                SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
                FROM (SELECT part, entry, i, CAST(sum(p[i]) AS DOUBLE) AS s, count(*) AS n
                      FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS i FROM a{n}) GROUP BY part, entry, i)
                GROUP BY part, entry) AS m USING (part, entry))"""

    chain = ",".join(assigned(n) + "," + next_books(n) for n in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, [CAST(floor({SCALE} * c) AS BIGINT) for c in x] AS v
            FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
            WHERE x IS NOT NULL AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0),
        parts AS MATERIALIZED (
            SELECT r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p FROM v, range({PARTS}) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, p AS c FROM parts WHERE r <= {ENTRIES}),
        {chain}, {assigned(rounds)},
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
        e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM v JOIN e USING (r), h
    """

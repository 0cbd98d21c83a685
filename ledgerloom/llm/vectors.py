"""Integer vectors of an embeddings table, shared by the operators on them.

A component x becomes floor(scale * x), x as double.  Rows whose vector is null
or holds null or non-finite components take no part.  Vectors of different
lengths are defined: the shorter ones are filled up with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vectors: DataFrame, scale: int, most: int, *more: str) -> DataFrame:
    """vec_id (long), v (array of long) and the columns ``more`` of the usable rows.

    A component beyond ``most`` would not leave room for exact sums in a long; it is an error that names the bound.
    """
    x = vectors["embedding"].cast("array<double>")

    def whole(c: Column) -> Column:
        n = F.floor(c * scale)
        fits = (c * scale >= -most) & (c * scale <= most)
        return F.when(fits, n).otherwise(F.raise_error(F.lit(f"a component is beyond {most} after scaling by {scale}")).cast("long"))

    kept = vectors.filter(usable(x))
    return kept.select(vectors["vec_id"].cast("long").alias("vec_id"), F.transform(x, whole).alias("v"), *[vectors[c] for c in more])


def padded(v: Column, length: int) -> Column:
    """The vector with zeros up to ``length``."""
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(v)))


def matrix(lists: pa.Array, length: int) -> np.ndarray:
    """Rows of an Arrow array of lists of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)

"""Embedding rows as integers: which rows take part, and how their components are floored."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there, with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad


def floored(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, x as double, held within +-limit."""
    value = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * F.greatest(F.least(x.cast("double"), F.lit(1e15)), F.lit(-1e15))), F.lit(limit)), F.lit(-limit))
    return F.transform(vector, lambda x: value(x).cast("int"))


def length_of_first(rows: DataFrame, vector: str, key: str) -> int:
    """The length of the vector whose row comes first by key (nulls last): that of the whole table."""
    first = rows.select(key, F.size(vector).alias("n")).orderBy(F.col(key).asc_nulls_last(), "n").limit(1).collect()
    return first[0]["n"] if first else 0


def limit_for(width: int, bits: int) -> int:
    """The largest component for which width squares of differences add up to less than 2^bits."""
    return min(2**30, isqrt(2**bits // max(width, 1)) // 2)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The integer lists of a column, all of one width, as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)

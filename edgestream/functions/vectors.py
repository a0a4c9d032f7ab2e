"""Scalar functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps)))


#: Encodings of an edge from its two ends.
ENCODINGS = {
    "hadamard": lambda x, y: x * y,
    "average": lambda x, y: (x + y) / 2,
    "l1": lambda x, y: F.abs(x - y),
    "l2": lambda x, y: (x - y) * (x - y),
}


def encode_edge(a: Column, b: Column, kind: str = "hadamard") -> Column:
    return F.zip_with(a, b, ENCODINGS[kind])


def haar(a: Column, size: int) -> Column:
    """Haar coefficients, coarse to fine, of an array padded with zeros to size (a power of two).

    Coefficient 2^l + b is (left half - right half) / sqrt(width) of block b of width size / 2^l.
    """
    padded = F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(a)))

    def details(width: int) -> Column:
        half = width // 2

        def one(k: Column) -> Column:
            left, right = F.slice(padded, k * width + 1, F.lit(half)), F.slice(padded, k * width + 1 + half, F.lit(half))
            return (total(left) - total(right)) / F.sqrt(F.lit(float(width)))

        return F.transform(F.sequence(F.lit(0), F.lit(size // width - 1)), one)

    levels = [size >> k for k in range(size.bit_length() - 1)]
    return F.concat(F.array(total(padded) / F.sqrt(F.lit(float(size)))), *map(details, levels))


def inverse_haar(a: Column, size: int) -> Column:
    """The array of which a are the Haar coefficients: each place sums its block's coefficient at each level."""

    def value(i: Column) -> Column:
        out, width = a[0] / F.sqrt(F.lit(float(size))), size
        while width > 1:
            block, half = F.floor(i / width), width // 2
            sign = F.when(F.pmod(i, F.lit(width)) < half, 1.0).otherwise(-1.0)
            out = out + sign * F.element_at(a, (block + size // width + 1).cast("int")) / F.sqrt(F.lit(float(width)))
            width = half
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value)


def time_encoding(dt: Column, width: int) -> Column:
    """cos(dt * 10^-w) for width frequencies w evenly from 0 to 9."""
    steps = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(steps, lambda k: F.cos(dt * F.pow(F.lit(10.0), -9.0 * k / max(width - 1, 1))))


def one_hot(x: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == x).cast("int"))


def min_max(a: Column, low: Column, high: Column) -> Column:
    """abs(x) scaled into [0, 1] by dimension, the sign kept; a flat dimension gives 0."""
    scaled = F.zip_with(F.transform(a, F.abs), F.arrays_zip(low.alias("low"), high.alias("high")), lambda x, r: F.coalesce(F.try_divide(x - r["low"], r["high"] - r["low"]), F.lit(0.0)))
    return F.zip_with(scaled, a, lambda s, x: s * F.signum(x))


def cosine_basis(dt: Column, frequencies: Column, phases: Column) -> Column:
    """cos(dt * w + b) for given (learned) frequencies and phases."""
    return F.zip_with(frequencies, phases, lambda w, b: F.cos(dt * w + b))

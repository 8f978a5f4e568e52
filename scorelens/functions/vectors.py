"""Array-column vector operations, evaluated JVM-side with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector_concat(a, b) -> Column:
    return F.concat(_col(a), _col(b))


def hadamard(a, b) -> Column:
    """Element-wise product (the interaction term of the two branches)."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def dot(a, b) -> Column:
    return F.aggregate(hadamard(a, b), F.lit(0.0), lambda acc, x: acc + x)


def silu(a) -> Column:
    """x / (1 + e^-x) on every element."""
    return F.transform(_col(a), lambda x: x / (F.lit(1.0) + F.exp(-x)))


def affine(a, weights: list[list[float]], bias: list[float]) -> Column:
    """W @ a + b for a small constant W (one output expression per row of W)."""
    v = _col(a)
    outs = []
    for row, b in zip(weights, bias):
        acc = F.lit(float(b))
        for j, w in enumerate(row):
            acc = acc + F.lit(float(w)) * v[j]
        outs.append(acc)
    return F.array(*outs)

"""Numeric helpers shared by Spark expressions and their SQL mirrors.

Each formula is written once as coefficients; ``horner`` renders it as a Spark
``Column`` and ``horner_sql`` as SQL text, so the oracle evaluates the same
operations in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_DIGITS = 9


def fixed(x: Column, digits: int = FIXED_DIGITS) -> Column:
    """Round half up to ``digits`` places as floor(x*10^d + 0.5) / 10^d.

    Written out (rather than ``round``) so Spark and DuckDB produce the same
    bits; it hides last-digit differences of sin/exp/sum order between engines.
    """
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def dlit(x: float) -> str:
    """A DOUBLE literal in SQL that parses to exactly this float."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def fixed_sql(x: str, digits: int = FIXED_DIGITS) -> str:
    scale = dlit(10 ** digits)
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def horner(coeffs, r: Column) -> Column:
    """coeffs[0]*r^(n-1) + ... + coeffs[-1], evaluated in Horner form."""
    acc = F.lit(float(coeffs[0]))
    for c in coeffs[1:]:
        acc = acc * r + F.lit(float(c))
    return acc


def horner_sql(coeffs, r: str) -> str:
    acc = dlit(coeffs[0])
    for c in coeffs[1:]:
        acc = f"({acc} * ({r}) + {dlit(c)})"
    return acc

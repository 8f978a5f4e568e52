"""Scroll-speed deviation curve (how far a speed is from 1.0, in [0, 1])."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import dlit

# The curve's pieces.  0 <= x < 1: (x-1)^2; 1 <= x < 3: a sine
# easing sin((x-2)*pi/2)/2 + 0.5; everything else (negative, >= 3): 1.
EASE_START = 1.0
EASE_END = 3.0


def speed_deviation(speed) -> Column:
    x = F.col(speed) if isinstance(speed, str) else speed
    low = (x - 1) * (x - 1)
    ease = F.sin((x - 2) * F.lit(math.pi) * F.lit(0.5)) / 2 + F.lit(0.5)
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when((x >= 0) & (x < EASE_START), low)
            .when((x >= EASE_START) & (x < EASE_END), ease)
            .otherwise(F.lit(1.0)))


def speed_deviation_sql(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL "
            f"WHEN ({x}) >= 0 AND ({x}) < {EASE_START} THEN (({x}) - 1) * (({x}) - 1) "
            f"WHEN ({x}) >= {EASE_START} AND ({x}) < {EASE_END} "
            f"THEN sin((({x}) - 2) * {dlit(math.pi)} * 0.5) / 2 + 0.5 "
            f"ELSE 1.0 END)")

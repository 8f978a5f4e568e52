"""Column expressions (all JVM-side built-ins)."""

from .curves import speed_deviation, speed_deviation_sql
from .normal import cdf, cdf_sql, inv_cdf, inv_cdf_sql
from .numeric import fixed, fixed_sql
from .scores import (composite_key, key_part, speed_class, speed_label,
                     weighted_accuracy)
from .text import item_title, json_first
from .vectors import affine, dot, hadamard, silu, vector_concat

__all__ = [
    "speed_deviation", "speed_deviation_sql", "cdf", "cdf_sql", "inv_cdf", "inv_cdf_sql",
    "fixed", "fixed_sql", "composite_key", "key_part", "speed_class", "speed_label",
    "weighted_accuracy", "item_title", "json_first", "affine", "dot",
    "hadamard", "silu", "vector_concat",
]

"""Per-score column expressions: weighted accuracy, speed class, composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): judgement counters in order, and the
# weight of each judgement over 320 used for curation.
JUDGEMENT_COLUMNS = ("countgeki", "count300", "countkatu", "count100", "count50", "countmiss")
WEIGHTS_320 = (320, 300, 200, 100, 50, 0)
WEIGHT_DENOMINATOR_320 = 320
# The game's own scale (MAX and 300 both count fully), over 300, for comparison.
WEIGHTS_GAME = (300, 300, 200, 100, 50, 0)
WEIGHT_DENOMINATOR_GAME = 300

# Mod bits that set the playback speed, and the class labels.
HALF_TIME_BIT = 8
DOUBLE_TIME_BIT = 6
SPEED_LABELS = {-1: "HT", 0: "NT", 1: "DT"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_accuracy(counts=JUDGEMENT_COLUMNS, weights=WEIGHTS_320,
                      denominator=WEIGHT_DENOMINATOR_320, as_float: bool = True) -> Column:
    """sum(count_i * w_i / d) / sum(count_i); NULL when there are no judgements.

    The terms are added left to right in judgement order, the same order as the
    curation SQL, so the double result is bit-identical across engines before
    the cast to 32-bit float (the stored type).
    """
    cols = [_col(c) for c in counts]
    num = None
    for c, w in zip(cols, weights):
        if w == 0:
            continue
        term = c if w == denominator else c * F.lit(w) / F.lit(denominator)
        num = term if num is None else num + term
    den = cols[0]
    for c in cols[1:]:
        den = den + c
    acc = F.try_divide(num.cast("double"), den)
    return acc.cast("float") if as_float else acc


def speed_class(mods="enabled_mods") -> Column:
    """Half time (bit 8) wins over double time (bit 6): -1 / 1 / 0."""
    m = _col(mods)
    return (F.when(F.shiftright(m, HALF_TIME_BIT).bitwiseAND(1) == 1, F.lit(-1))
            .when(F.shiftright(m, DOUBLE_TIME_BIT).bitwiseAND(1) == 1, F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def speed_label(speed="speed") -> Column:
    s = _col(speed)
    out = None
    for k, v in SPEED_LABELS.items():
        out = (F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v)))
    return out


def composite_key(a, b) -> Column:
    """``"<a>/<b>"``; NULL when either part is NULL (unlike concat_ws)."""
    return F.concat(_col(a).cast("string"), F.lit("/"), _col(b).cast("string"))


def key_part(key, index: int, as_int: bool = False) -> Column:
    """1-based part of a composite key; the first part decodes to an int id."""
    part = F.split_part(_col(key), F.lit("/"), F.lit(index))
    return part.cast("int") if as_int else part

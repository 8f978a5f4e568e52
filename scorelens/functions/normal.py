"""Standard normal quantile and CDF as column expressions.

Spark SQL has neither erf nor an inverse normal, so both are polynomials:

* quantile: Wichura's AS241 (PPND16), accurate to about 1e-16;
* CDF: Hart's rational approximation in West's double-precision form.

``*_sql`` render the same operations for the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import dlit, horner, horner_sql

# AS241 coefficients, highest power first.
AS241_CENTRAL_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
                     45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
                     133.14166789178437745, 3.387132872796366608)
AS241_CENTRAL_DEN = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
                     21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
                     42.313330701600911252, 1.0)
AS241_MID_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                 4.6303378461565452959, 1.42343711074968357734)
AS241_MID_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                 2.05319162663775882187, 1.0)
AS241_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                  0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                  5.4637849111641143699, 6.6579046435011037772)
AS241_TAIL_DEN = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
                  7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                  0.59983220655588793769, 1.0)

# Hart's CDF approximation, highest power first.
HART_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SWITCH = 7.07106781186547
HART_FAR = 37.0
SQRT_2PI = 2.506628274631


def _central(q: Column, r: Column) -> Column:
    return q * horner(AS241_CENTRAL_NUM, r) / horner(AS241_CENTRAL_DEN, r)


def _outer(r: Column) -> Column:
    mid = horner(AS241_MID_NUM, r - 1.6) / horner(AS241_MID_DEN, r - 1.6)
    tail = horner(AS241_TAIL_NUM, r - 5.0) / horner(AS241_TAIL_DEN, r - 5.0)
    return F.when(r <= 5.0, mid).otherwise(tail)


def _radius(p: Column, q: Column) -> Column:
    return F.sqrt(-F.log(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))


def inv_cdf(p: Column) -> Column:
    """Quantile of the standard normal; NULL outside (0, 1)."""
    q = p - F.lit(0.5)
    x_t = _outer(_radius(p, q))
    x_t = F.when(q < 0, -x_t).otherwise(x_t)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, _central(q, F.lit(0.180625) - q * q))
            .otherwise(x_t))


def with_inv_cdf(df: DataFrame, p: str, out: str) -> DataFrame:
    """``df`` with ``inv_cdf`` of the column ``p``, the same arithmetic in steps of a column
    each: as one expression every use of a step repeats its code, which is then too long for
    the JVM to compile."""
    q = F.col("_q")
    t = df.withColumn("_q", F.col(p) - F.lit(0.5))
    t = t.withColumns({"_rc": F.lit(0.180625) - q * q, "_rt": F.when(F.abs(q) > 0.425, _radius(F.col(p), q))})
    t = t.withColumns({"_xc": _central(q, F.col("_rc")), "_xt": _outer(F.col("_rt"))})
    x = (F.when((F.col(p) <= 0) | (F.col(p) >= 1), F.lit(None).cast("double"))
         .when(F.abs(q) <= 0.425, F.col("_xc")).when(q < 0, -F.col("_xt")).otherwise(F.col("_xt")))
    return t.withColumn(out, x).drop("_q", "_rc", "_rt", "_xc", "_xt")


def cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    near = e * horner(HART_NUM, a) / horner(HART_DEN, a)
    b = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / F.lit(SQRT_2PI)
    lower = (F.when(a > HART_FAR, F.lit(0.0))
             .when(a < HART_SWITCH, near)
             .otherwise(far))
    return F.when(x > 0, F.lit(1.0) - lower).otherwise(lower)


def inv_cdf_sql(p: str) -> str:
    q = f"(({p}) - 0.5)"
    r_c = f"(0.180625 - {q} * {q})"
    central = f"({q} * {horner_sql(AS241_CENTRAL_NUM, r_c)} / {horner_sql(AS241_CENTRAL_DEN, r_c)})"
    r_t = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    rm = f"({r_t} - 1.6)"
    rt = f"({r_t} - 5.0)"
    mid = f"({horner_sql(AS241_MID_NUM, rm)} / {horner_sql(AS241_MID_DEN, rm)})"
    tail = f"({horner_sql(AS241_TAIL_NUM, rt)} / {horner_sql(AS241_TAIL_DEN, rt)})"
    x_t = f"(CASE WHEN {r_t} <= 5.0 THEN {mid} ELSE {tail} END)"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{x_t} ELSE {x_t} END)")


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2.0)"
    near = f"({e} * {horner_sql(HART_NUM, a)} / {horner_sql(HART_DEN, a)})"
    b = f"({a} + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        b = f"({a} + {k} / {b})"
    far = f"({e} / {b} / {dlit(SQRT_2PI)})"
    lower = (f"(CASE WHEN {a} > {dlit(HART_FAR)} THEN 0.0 WHEN {a} < {dlit(HART_SWITCH)} "
             f"THEN {near} ELSE {far} END)")
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {lower} ELSE {lower} END)"


# Output clip of the quantile transform: the normal quantile of 1e-7 - eps
# (the transform's bound threshold), mirrored for the upper side.
BOUNDS_THRESHOLD = 1e-7


def _py_inv_cdf(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


CLIP_LOW = _py_inv_cdf(BOUNDS_THRESHOLD - math.ulp(1.0))
CLIP_HIGH = _py_inv_cdf(1 - (BOUNDS_THRESHOLD - math.ulp(1.0)))

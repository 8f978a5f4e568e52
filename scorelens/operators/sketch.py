"""Mergeable quantiles: a KLL sketch for each part of a dataset, merged on demand.

The exact fit (``features``) reads every value again when files are added.  Here each part
(a year, a day, a load) is read once and leaves one row of some KB; new parts are appended and
the quantiles of any set of parts come from its rows alone.  The sketches' compaction is
random: two runs may differ within ``rank_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2000  # items kept on a sketch's top level; 8 to 65535


def rank_error(k: int = K) -> float:
    """Rank error (a share of the rows) of one quantile at 99 % confidence (the sketch's
    published fit, fixed values)."""
    return 2.296 / k ** 0.9723


def part_sketches(df: DataFrame, value: Column | str, part: Column | str, k: int = K) -> DataFrame:
    """``(part, n, sketch)``: one row per part with a value.  NULL and NaN values are left out, a
    NULL part is a part.  Partial sketches combine map-side, so a hot part is no hot task."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    p = F.col(part) if isinstance(part, str) else part
    return (df.select(p.alias("part"), v.alias("v")).where("v is not null and not isnan(v)").groupBy("part")
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch")))


def merged_quantiles(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """``(q, value, n)``: the quantiles of all parts together; no rows without a part."""
    whole = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).where("n > 0")
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    found = F.arrays_zip(qs.alias("q"), F.kll_sketch_get_quantile_double("sketch", qs).alias("value"))
    return whole.select("n", F.explode(found).alias("x")).select("x.q", "x.value", "n")


def rank_spans(df: DataFrame, value: Column | str, found: DataFrame) -> DataFrame:
    """``(q, value, n, below, upto)``: how many values lie below each quantile's value and how many do
    not exceed it.  ``found`` has a row per asked quantile and goes along as literals."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = found.collect()  # as many as were asked for
    seen = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    if not rows:
        return found.select("*", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("upto"))
    counts = seen.agg(*[f(F.col("v"), F.lit(r["value"])).alias(f"{n}{i}") for i, r in enumerate(rows) for n, f in (
        ("a", lambda c, x: F.count_if(c < x)), ("b", lambda c, x: F.count_if(c <= x)))])
    made = [F.struct(F.lit(r["q"]).alias("q"), F.lit(r["value"]).alias("value"), F.lit(r["n"]).cast("bigint").alias("n"),
                     F.col(f"a{i}").alias("below"), F.col(f"b{i}").alias("upto")) for i, r in enumerate(rows)]
    return counts.select(F.explode(F.array(*made)).alias("x")).select("x.*")

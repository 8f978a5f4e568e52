"""Scroll-variance metric of a step function (``svness``).

A step table ``(key, offset, speed)`` says the speed holds from ``offset`` to
the next offset of the same key.  The metric is the time-weighted mean of the
deviation curve over the key's span::

    sum_i dev(speed_i) * (offset_{i+1} - offset_i) / (max(offset) - min(offset))

(the last step has no length).  One step gives 0; several steps that share a
single offset give 0/0, which is NULL here.  Ties in ``offset`` are ordered by
``speed``.

Steps are first summed per (key, offset), which combines map-side: of equal
offsets only the last speed has a length.  The "next offset" is a ``lead``
window.  A plain ``partitionBy(key)`` window would put every step of a key into
one task, so a hot key would serialise the job.  Here a key with more than
``rows_per_bucket`` offsets is cut into ``BUCKETS`` buckets at its own offset
quantiles (so a burst of steps is split like any other part), the lead runs per
(key, bucket), and one more lead over the small per-bucket summary adds the
step that crosses each bucket boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import speed_deviation
from ..sources.sinks import stage

DEFAULT_ROWS_PER_BUCKET = 1 << 20
BUCKETS = 256
STEPS_PER_TASK = "8m"  # shuffled; sorting and summing take some 20 times that in memory


def scroll_variance(steps: DataFrame, key: str = "mid",
                    rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET,
                    stage_mode: str = "none") -> DataFrame:
    """``stage_mode`` as in ``sources.sinks.stage``: the summed steps feed both the cuts and
    the windows."""
    s = (steps.select(F.col(key).alias("k"), F.col("offset").cast("double").alias("o"),
                      F.col("speed").cast("double").alias("v")).where(F.col("o").isNotNull())
         .groupBy("k", "o").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n")))
    if rows_per_bucket:
        s = stage(s, "steps", stage_mode, STEPS_PER_TASK)
        hot = s.groupBy("k").agg(F.count(F.lit(1)).alias("n_k")).where(F.col("n_k") > rows_per_bucket).select("k")
        cuts = (s.join(hot, "k", "left_semi").groupBy("k")
                .agg(F.array_distinct(F.percentile_approx("o", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).alias("cuts")))
        s = s.join(cuts, "k", "left")
        bucket = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("o"))))
        s = s.select("k", "o", "v", "n", bucket.cast("long").alias("b"))
    else:
        s = s.withColumn("b", F.lit(0).cast("long"))

    w1 = Window.partitionBy("k", "b").orderBy("o")
    nxt = F.lead("o").over(w1)
    inner = (s.withColumn("len", nxt - F.col("o"))
             .groupBy("k", "b")
             .agg(F.sum(F.when(F.col("len").isNotNull(), speed_deviation("v") * F.col("len")))
                  .alias("part"),
                  F.min("o").alias("lo"), F.max("o").alias("hi"),
                  F.max_by("v", "o").alias("last_v"),
                  F.sum("n").alias("n")))

    w2 = Window.partitionBy("k").orderBy("b")
    cross = speed_deviation("last_v") * (F.lead("lo").over(w2) - F.col("hi"))
    per_key = (inner.withColumn("edge", cross)
               .groupBy("k")
               .agg(F.sum(F.coalesce("part", F.lit(0.0))).alias("inside"),
                    F.sum(F.coalesce("edge", F.lit(0.0))).alias("edges"),
                    F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                    F.sum("n").alias("n")))
    total = F.col("inside") + F.col("edges")
    svness = (F.when(F.col("n") == 1, F.lit(0.0))
              .otherwise(F.try_divide(total, F.col("hi") - F.col("lo"))))
    return per_key.select(F.col("k").alias(key), svness.alias("svness"))


def item_metric(keys: DataFrame, steps: DataFrame, key: str = "mid",
                rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET,
                stage_mode: str = "none") -> DataFrame:
    """Metric for every requested key; keys without step data keep a NULL
    metric (the reference reports the missing input and leaves it empty)."""
    k = keys.select(key).distinct()
    relevant = steps.join(k, key, "left_semi")
    return k.join(scroll_variance(relevant, key, rows_per_bucket, stage_mode), key, "left")

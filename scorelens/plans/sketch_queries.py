"""Registered query: quantiles of all scores' accuracies from one sketch per year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weighted_accuracy
from ..operators.sketch import merged_quantiles, part_sketches, rank_error, rank_spans
from ..sources import fixture
from ..sources.sinks import stage
from .curation_sql import with_curation
from .registry import register

DECILES = [i / 10 for i in range(11)]


@register("quantile_sketch", with_curation(
    "SELECT CAST(i / 10.0 AS DOUBLE) AS q, (SELECT count(*) FROM derived WHERE accuracy_320 IS NOT NULL) AS n, "
    "true AS within_error FROM range(11) t(i)"))
def q_quantile_sketch(spark, sf_dir):
    """Each decile, and whether its true rank is within three times the sketch's stated error
    (the value's own ties count as its rank)."""
    scores = fixture.scores(spark, sf_dir)
    kept = stage(part_sketches(scores, weighted_accuracy(), F.year("date")), "accuracy_sketches")
    spans = rank_spans(scores, weighted_accuracy(), stage(merged_quantiles(kept, DECILES), "accuracy_deciles"))
    off = 3 * rank_error()
    return spans.select("q", "n", ((F.col("below") <= (F.col("q") + off) * F.col("n"))
                                   & (F.col("upto") >= (F.col("q") - off) * F.col("n"))).alias("within_error"))

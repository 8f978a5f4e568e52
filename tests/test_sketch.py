"""Quantile sketches by part: merged, extended, empty."""

from pyspark.sql import functions as F

from scorelens.operators.sketch import merged_quantiles, part_sketches, rank_error, rank_spans


def test_merged_parts_are_the_whole_within_the_error(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("part"), ((F.col("id") * 7919) % 200_000).cast("double").alias("v"))
    kept = part_sketches(df.where("part < 5"), "v", "part", 400)
    more = kept.unionByName(part_sketches(df.where("part >= 5"), "v", "part", 400))
    assert more.count() == 7
    for q, value, n in merged_quantiles(more, [0.0, 0.01, 0.5, 0.99, 1.0]).collect():
        assert n == 200_000 and abs(value / n - q) <= 3 * rank_error(400)
    assert merged_quantiles(more, [0.0, 1.0]).collect()[1].value == 199_999


def test_nulls_nans_and_empty_parts(spark):
    rows = [(1, 1.0), (1, None), (1, float("nan")), (None, 3.0), (2, None)]
    df = spark.createDataFrame(rows, "part int, v double")
    kept = part_sketches(df, "v", "part")
    assert {(r.part, r.n) for r in kept.collect()} == {(1, 1), (None, 1)}
    found = merged_quantiles(kept, [0.0, 1.0])
    assert [tuple(r) for r in rank_spans(df, "v", found).orderBy("q").collect()] == [(0.0, 1.0, 2, 0, 1), (1.0, 3.0, 2, 1, 2)]
    none = merged_quantiles(part_sketches(df.limit(0), "v", "part"), [0.5])
    assert none.count() == 0 and rank_spans(df, "v", none).count() == 0

"""Steps of the fit: joined rows are made once, only rows near a cut are ranked, blocks follow the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.functions.normal import inv_cdf, with_inv_cdf
from scorelens.operators import features as FT
from scorelens.operators import head as HD
from scorelens.operators import model as MD


def counted(df, col, dtype):
    """``df`` with a counter of the times that a row of it is made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        made.add(1)
        return x

    return df.withColumn(col, F.udf(same, dtype).asNondeterministic()(col)), made


def test_blocks_follow_the_rows():
    assert MD.als_blocks(10) == MD.als_blocks(1_000_000) == 2
    assert MD.als_blocks(22_000_000) >= 12


def test_quantile_in_steps_is_the_same(spark):
    p = [None, float("nan"), -1.0, 0.0, 1.0, 2.0, 0.5, 0.075, 0.925, 1e-300, 1e-12, 1 - 1e-12, *np.random.default_rng(3).random(500).tolist()]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    both = with_inv_cdf(df.withColumn("a", inv_cdf(F.col("p"))), "p", "b")
    assert both.columns == ["p", "a", "b"]
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert both.where((F.col("p") > 0) & (F.col("p") < 1) & F.col("b").isNull()).count() == 0


def test_split_ranks_only_rows_near_a_cut(spark, monkeypatch):
    ranked = []
    own = FT.row_index

    def row_index(df, *args):
        ranked.append(df.count())
        return own(df, *args)

    monkeypatch.setattr(FT, "row_index", row_index)
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 9).alias("x"))
    got = {r.k: r.part for r in FT.exact_split(df, (0.8, 0.1, 0.1), seed=7).collect()}
    order = [r.k for r in df.withColumn("h", FT.split_hash(df, 7)).orderBy("h", "k", "x").collect()]
    assert got == {k: "train" if i < 4000 else "test" if i < 4500 else "val" for i, k in enumerate(order)}
    assert sum(ranked) < 500


@pytest.mark.parametrize("n", [0, 1, 2, 7])
@pytest.mark.parametrize("fractions", [(0.8, 0.1, 0.1), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)])
def test_split_of_few_and_equal_rows(spark, n, fractions):
    df = spark.range(n).select(F.lit("a").alias("k"))
    got = {r.part: r["count"] for r in FT.exact_split(df, fractions, seed=7).groupBy("part").count().collect()}
    assert got == {p: s for p, s in zip(FT.PARTS, FT.split_sizes(n, fractions)) if s}


def test_groups_are_summed_once(spark):
    df, made = counted(spark.range(60, numPartitions=2).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("y")), "y", "double")
    assert MD.shrunk_means(df, "k", F.col("y")).count() == 5
    assert made.value == 60


def test_head_makes_its_rows_once(spark):
    rows = spark.range(80, numPartitions=2).select(
        *[F.array((F.col("id") % m).cast("float"), (F.col("id") % (m + 2)).cast("float")).alias(c) for c, m in (("eu", 3), ("em", 4))],
        (F.col("id") / 80).alias("y"), F.when(F.col("id") < 60, "train").otherwise("val").alias("part"),
        F.col("id").cast("string").alias("uid"), F.col("id").cast("string").alias("mid"))
    rows, made = counted(rows, "y", "double")
    assert len(HD.train_head(rows, HD.HeadConfig(dim=2, epochs=2)).log) == 2
    assert made.value == 80


def test_a_fit_leaves_only_what_its_model_reads(spark):
    import os

    from scorelens.plans.modeling import holdout_predictions, train
    from scorelens.session import scratch_path

    def staged():
        top = os.path.dirname(os.path.dirname(scratch_path(spark, "fitted"))).removeprefix("file://")
        return {f"{d}/{x}" for d in ("groups", "item_residuals", "residuals", "fitted") if os.path.isdir(f"{top}/{d}") for x in os.listdir(f"{top}/{d}")}

    before = staged()
    h = F.xxhash64("id")
    export = spark.range(900).select(F.concat(F.pmod(h, F.lit(20)).cast("string"), F.lit("/0")).alias("mid"),
                                     F.concat(F.pmod(F.shiftright(h, 20), F.lit(30)).cast("string"), F.lit("/1")).alias("uid"),
                                     (F.lit(0.8) + F.pmod(h, F.lit(97)) / 500).cast("float").alias("accuracy"))
    tr = train(export)
    assert staged() == before
    assert holdout_predictions(tr).where("pred IS NOT NULL").count() == 90
    assert tr.model.users.count() == 30 and tr.model.items.count() == 20

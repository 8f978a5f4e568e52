"""Label codes, ranking, quantile transform, split: laws and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.operators import features as FT
from scorelens.operators.ranking import prefix_sum, row_index


def test_row_index_is_a_permutation(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    idx = row_index(df, ["v"], "i", n_partitions=6).orderBy("v").select("i").collect()
    assert [r.i for r in idx] == list(range(5000))


def test_prefix_sum_weights(spark):
    df = spark.createDataFrame([(3, 2), (1, 5), (2, 1)], "v int, w int")
    got = {r.v: r.cum for r in prefix_sum(df, ["v"], "w", "cum", 2).collect()}
    assert got == {1: 5, 2: 6, 3: 8}


def test_label_codes_sorted_and_roundtrip(spark):
    df = spark.createDataFrame([("9/0",), ("10/1",), ("10/-1",), ("10/0",), ("9/0",)], "k string")
    codes = FT.label_codes(df, "k").orderBy("code").collect()
    assert [r.label for r in codes] == sorted({"9/0", "10/1", "10/-1", "10/0"})
    assert [r.code for r in codes] == [0, 1, 2, 3]
    c = FT.label_codes(df, "k")
    back = FT.decode(FT.encode(df, "k", c, "code"), "code", c, "k2")
    assert back.where(F.col("k") != F.col("k2")).count() == 0


def test_unknown_label_raises(spark):
    known = spark.createDataFrame([("a",)], "k string")
    c = FT.label_codes(known, "k")
    req = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(ValueError):
        FT.check_known(req, {"k": c})


def test_quantiles_match_numpy_and_inverse(spark):
    rng = np.random.default_rng(1)
    xs = np.round(rng.beta(8, 1, 3000), 3)  # many ties
    df = spark.createDataFrame([(float(x),) for x in xs], "a double")
    qm = FT.fit_quantiles(df, "a", 1000)
    ref = np.percentile(xs, np.array(qm.references) * 100)
    assert np.allclose(qm.quantiles, ref, atol=1e-12)
    z = FT.normalize(df, "a", qm, "z")
    back = FT.inverse(z, "z", qm, "b")
    d = back.select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert d < 1e-6
    lo_hi = z.agg(F.min("z"), F.max("z")).first()
    assert -5.2 < lo_hi[0] < 0 < lo_hi[1] < 5.2


def test_tied_quantiles_map_to_middle(spark):
    df = spark.createDataFrame([(0.5,)] * 10 + [(0.7,)] * 10, "a double")
    qm = FT.fit_quantiles(df, "a", 20)
    u = FT.to_uniform(spark.createDataFrame([(0.6,)], "a double"), "a", qm, "u").first().u
    assert 0 < u < 1
    # exact midpoint between the two tie runs: the interpolation is symmetric
    assert abs(u - 0.5) < 1e-12


def test_exact_split_sizes_disjoint_complete(spark):
    df = spark.range(0, 1001).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    s = FT.exact_split(df, (0.8, 0.1, 0.1), seed=5)
    sizes = {r.part: r["count"] for r in s.groupBy("part").count().collect()}
    assert sizes == {"train": 800, "test": 100, "val": 101}
    assert s.select("x").distinct().count() == 1001
    again = FT.exact_split(df.repartition(5), (0.8, 0.1, 0.1), seed=5)
    assert s.exceptAll(again).count() == 0


def test_split_fractions_must_sum_to_one():
    with pytest.raises(ValueError):
        FT.split_sizes(10, (0.5, 0.1, 0.1))


def test_split_spreads_a_hot_group_of_copies(spark):
    # a third of the rows are one repeated row: sizes stay exact and the
    # copies are not confined to one range partition
    hot = spark.range(0, 3000).select(F.lit(1).alias("x"), F.lit(1).alias("y"))
    rest = spark.range(0, 6000).select(F.col("id").alias("x"), (F.col("id") % 5).alias("y"))
    df = hot.unionByName(rest)
    s = FT.exact_split(df, (0.8, 0.1, 0.1), seed=9, n_partitions=8)
    sizes = {r.part: r["count"] for r in s.groupBy("part").count().collect()}
    assert sizes == {"train": 7200, "test": 900, "val": 900}
    assert s.where((F.col("x") == 1) & (F.col("y") == 1)).count() == 3000 + 1


def test_label_codes_many_equals_separate(spark):
    df = spark.createDataFrame([("b", "z/1"), ("a", "y/0"), ("b", "x/-1"), ("c", "y/0")], "u string, m string")
    many = FT.label_codes_many(df, ["u", "m"])
    for col in ("u", "m"):
        a = sorted(tuple(r) for r in many[col].collect())
        b = sorted(tuple(r) for r in FT.label_codes(df, col).collect())
        assert a == b

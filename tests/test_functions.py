"""Column expressions on hand-made rows."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from scorelens.functions import (cdf, composite_key, inv_cdf, key_part, speed_class,
                                 speed_deviation, weighted_accuracy)
from scorelens.functions.scores import WEIGHT_DENOMINATOR_GAME, WEIGHTS_GAME

COUNTS = "countgeki bigint, count300 bigint, countkatu bigint, count100 bigint, count50 bigint, countmiss bigint"


def test_weighted_accuracy_values_and_zero_judgements(spark):
    df = spark.createDataFrame([(10, 0, 0, 0, 0, 0), (0, 10, 0, 0, 0, 0), (0, 0, 0, 0, 0, 10),
                                (0, 0, 0, 0, 0, 0), (1, 1, 1, 1, 1, 1)], COUNTS)
    got = [r[0] for r in df.select(weighted_accuracy(as_float=False)).collect()]
    assert got[0] == 1.0
    assert got[1] == 300 / 320
    assert got[2] == 0.0
    assert got[3] is None  # no judgements: NULL, not an error
    assert math.isclose(got[4], (1 + 300 / 320 + 200 / 320 + 100 / 320 + 50 / 320) / 6)
    game = df.select(weighted_accuracy(weights=WEIGHTS_GAME, denominator=WEIGHT_DENOMINATOR_GAME,
                                       as_float=False)).collect()
    assert game[1][0] == 1.0


def test_accuracy_is_float_and_bounds_follow_float(spark):
    # 0.9 as float is below the double 0.9; 0.85 as float is above 0.85
    df = spark.createDataFrame([(0.9,), (0.85,), (1.0,)], "a double")
    f = df.select(F.col("a").cast("float").alias("a"))
    inside = [r[0] for r in f.select(F.col("a").between(0.9, 1.0)).collect()]
    assert inside == [False, False, True]
    ge = [r[0] for r in f.select(F.col("a") >= 0.85).collect()]
    assert ge == [True, True, True]


def test_speed_class_half_time_wins(spark):
    df = spark.createDataFrame([(0,), (64,), (256,), (320,), (8,), (72,)], "enabled_mods int")
    assert [r[0] for r in df.select(speed_class()).collect()] == [0, 1, -1, -1, 0, 1]


def test_speed_deviation_curve(spark):
    xs = [-0.5, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(speed_deviation("x")).collect()]
    assert got[0] == 1.0 and got[1] == 1.0 and got[2] == 0.25
    assert abs(got[3] - 0.0) < 1e-15 and abs(got[4] - 0.5) < 1e-15
    assert got[5] == 1.0 and got[6] == 1.0 and got[7] is None


def test_normal_polynomials_match_python(spark):
    ps = [1e-10, 1e-7, 0.001, 0.02425, 0.1, 0.3, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(inv_cdf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert abs(g - NormalDist().inv_cdf(p)) < 1e-12, p
    xs = [-8.0, -5.0, -1.5, -0.3, 0.0, 0.4, 2.0, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(cdf(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - NormalDist().cdf(x)) < 1e-14, x
    edge = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(inv_cdf(F.col("p"))).collect()
    assert edge[0][0] is None and edge[1][0] is None


def test_composite_key_null_and_decode(spark):
    df = spark.createDataFrame([(10, -1), (None, 0)], "a bigint, b int")
    keys = [r[0] for r in df.select(composite_key("a", "b")).collect()]
    assert keys == ["10/-1", None]
    d = spark.createDataFrame([("2193881/2020",)], "k string")
    r = d.select(key_part("k", 1, as_int=True).alias("u"), key_part("k", 2).alias("y")).first()
    assert r["u"] == 2193881 and r["y"] == "2020"

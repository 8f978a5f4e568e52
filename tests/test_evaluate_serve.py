"""Evaluation aggregates and serving steps on hand-made rows."""

import numpy as np
from pyspark.sql import functions as F

from scorelens.operators import evaluate as EV
from scorelens.operators import serve as SV


def test_error_bins_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.5, 0.6), (0.705, 0.715), (0.7, 0.7)],
                               "y double, pred double")
    rows = {r.bin: r for r in EV.error_by_bin(df, "y", "pred").collect()}
    assert len(rows) == 30
    assert rows[0].n == 2 and abs(rows[0].mae - 0.005) < 1e-9
    assert rows[29].n == 0 and rows[29].mae is None   # y = 1.0 is in no bin
    assert rows[29].bound == "100%" and rows[0].bound == "71%"


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(0, 1, 2000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["count"] for r in EV.histogram(df, "x", 25).orderBy("bin").collect()]
    want, _ = np.histogram(xs, bins=25)
    assert got == list(want)


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    got = [r["count"] for r in EV.histogram(df, "x", 4).orderBy("bin").collect()]
    want, _ = np.histogram(np.array([2.0] * 5), bins=4)
    assert got == list(want)


def test_regression_metrics(spark):
    y = np.array([0.9, 0.95, 0.99, 0.8])
    p = np.array([0.91, 0.93, 0.97, 0.85])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, pred double")
    r = EV.regression_metrics(df, "y", "pred").first()
    assert abs(r.mae - np.abs(p - y).mean()) < 1e-9
    assert abs(r.rmse - np.sqrt(((p - y) ** 2).mean())) < 1e-9
    r2 = 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    r2s = 1 - ((p - y) ** 2).sum() / ((p - p.mean()) ** 2).sum()
    assert abs(r.r2 - r2) < 1e-9 and abs(r.r2_swapped - r2s) < 1e-9


def test_grid_latest_year_and_missing_nt(spark):
    req = spark.createDataFrame([(1, 7, 5)], "rid int, user_id bigint, beatmap_id bigint")
    g = SV.request_grid(req, "user_id", "beatmap_id", 2023)
    assert g.count() == 33
    scored = (g.where(F.col("year").isin(2020, 2022) & (F.col("speed") != 0))
              .withColumn("pred", F.when(F.col("speed") == 1, 0.0).otherwise(0.9)))
    kept = SV.truthy(scored)           # prediction 0.0 is dropped
    lat = SV.latest_year(kept, ["rid"])
    assert {r.year for r in lat.collect()} == {2022}
    c = SV.speed_comparison(lat, ["rid"]).first()
    assert c.HT == 0.9 and c.NT is None and c.DT is None and c.delta_ht is None


def test_resolve_user_by_id_or_name(spark):
    users = spark.createDataFrame([(1, "alice"), (22, "bob")], "user_id bigint, username string")
    req = spark.createDataFrame([("22",), ("alice",), ("nobody",)], "t string")
    got = {r.t: (r.uid, r.username) for r in SV.resolve_user(req, "t", users).collect()}
    assert got == {"22": (22, "bob"), "alice": (1, "alice"), "nobody": (None, None)}


def test_unplayed_counts(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "uid string, mid string")
    got = {r.uid: (r.n_played, r.n_unplayed) for r in SV.unplayed_counts(e).collect()}
    assert got == {"a": (2, 0), "b": (1, 1)}

"""Metrics on NaN, huge, infinite and empty input; bursts of steps; user lookup edges."""

import math

import pytest
from pyspark.sql import functions as F

from scorelens.operators import evaluate as EV
from scorelens.operators import serve as SV
from scorelens.operators.metric import scroll_variance

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, "y double, pred double")


def test_nan_is_not_a_perfect_score(spark):
    m = EV.regression_metrics(frame(spark, [(0.5, 0.5), (0.6, NAN)])).first()
    assert m.n == 2 and all(math.isnan(m[c]) for c in ("mae", "rmse", "r2"))


def test_huge_values_and_no_rows(spark):
    m = EV.regression_metrics(frame(spark, [(1e12, 3e12), (3e12, 1e12)])).first()
    assert (m.mae, m.rmse, m.r2) == (2e12, 2e12, pytest.approx(-3.0))
    none = EV.regression_metrics(frame(spark, [])).first()
    assert none.n == 0 and none.mae is None and none.r2 is None


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(x,) for x in (1e12, 2e12, 3e12, NAN, INF, -INF, None)], "x double")
    rows = sorted(EV.histogram(df, "x", 4).collect(), key=lambda r: r.bin)
    assert [r["count"] for r in rows] == [3, 1, 0, 1, 1]  # bin -1: NaN and infinities
    assert (rows[1].lo, rows[-1].hi, rows[0].lo) == (1e12, 3e12, None)
    only = EV.histogram(spark.createDataFrame([(NAN,)], "x double"), "x", 2).collect()
    assert sorted((r.bin, r.lo, r["count"]) for r in only) == [(-1, None, 1), (0, None, 0), (1, None, 0)]
    assert {r["count"] for r in EV.histogram(df.limit(0), "x", 2).collect()} == {0}


def test_error_bins_leave_nan_truth_out(spark):
    rows = EV.error_by_bin(frame(spark, [(0.705, 0.7), (0.705, NAN), (NAN, 0.7), (None, 0.7)])).collect()
    first = next(r for r in rows if r.bin == 0)
    assert first.n == 2 and math.isnan(first.mae) and sum(r.n for r in rows) == 2


def test_minmax_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, NAN]), (2, [3.0, 5.0, 2.0]), (3, None), (4, [2.0, None, 4.0])], "id int, v array<double>")
    got = {r.id: r.scaled for r in EV.minmax_scaled(df, "id", "v").collect()}
    assert got[2] == [1.0, 0.0, 0.0] and got[3] is None and got[4] == [0.5, None, 1.0]
    assert got[1][:2] == [0.0, 0.0] and math.isnan(got[1][2])


def test_a_burst_of_steps_is_split(spark):
    burst = spark.range(20_000).selectExpr("1L mid", "cast(1000000000 + id as double) `offset`", "1.0 + (id % 7) / 10 speed")
    steps = burst.unionByName(spark.createDataFrame([(1, 0.0, 3.0), (2, 5.0, 1.0), (2, 5.0, 2.0), (3, 1.0, 1.0)], burst.schema))
    a = {r.mid: r.svness for r in scroll_variance(steps, rows_per_bucket=None).collect()}
    b = {r.mid: r.svness for r in scroll_variance(steps, rows_per_bucket=100).collect()}
    assert a.keys() == b.keys() and a[2] is b[2] is None and a[3] == b[3] == 0.0
    assert a[1] == pytest.approx(b[1], rel=1e-12)


def test_user_lookup_edges(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "bob"), (None, "nul"), (4, None)], "user_id long, username string")
    req = spark.createDataFrame([(0, "9" * 25), (1, "2"), (2, "bob"), (3, None), (4, "zed"), (5, "77"), (6, "4")], "event_id long, user_text string")
    got = {r.event_id: (r.uid, r.username) for r in SV.resolve_user(req, "user_text", users).collect()}
    assert got == {0: (None, None), 1: (2, "bob"), 2: (2, "bob"), 3: (None, None), 4: (None, None), 5: (77, None), 6: (4, None)}


def test_known_pairs_equal_the_filtered_grid(spark):
    req = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 10, 6), (4, None, 5), (5, 99, 99)], "event_id long, user_id long, beatmap_id long")
    uids = spark.createDataFrame([("10/2001",), ("10/1995",), ("10/1980",), ("11/2000",)], "label string")
    mids = spark.createDataFrame([("5/0",), ("5/-1",), ("6/1",), ("7/0",)], "label string")
    grid = SV.request_grid(req, "user_id", "beatmap_id", 2001)
    want = (grid.join(uids.withColumnRenamed("label", "uid_key"), "uid_key", "left_semi")
            .join(mids.withColumnRenamed("label", "mid_key"), "mid_key", "left_semi"))
    got = SV.known_pairs(req, SV.user_years(uids, 2001), SV.item_speeds(mids))
    cols = ["event_id", "year", "speed", "uid_key", "mid_key", "speed_label"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect()) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan  # no grid of 33 rows per request

"""Frames that several steps of a query read are made once, and keys are expanded once per user."""

import contextlib
import io

from pyspark.sql import functions as F

from scorelens.operators import serve as SV
from scorelens.plans import curation_queries as CQ
from scorelens.plans import evaluation_queries as EQ
from scorelens.plans import serving_queries as SQ
from scorelens.plans.modeling import evaluation_report
from scorelens.sources import sinks as SK


def joins(df) -> int:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return sum("Join" in line for line in out.getvalue().split("Initial Plan")[0].splitlines())


def test_report_makes_the_predictions_once(spark):
    made = spark.sparkContext.accumulator(0)

    def shifted(x):
        made.add(1)
        return x + 0.01

    pred = spark.range(40, numPartitions=2).select((F.lit(0.8) + F.col("id") / 400).alias("y"))
    pred = pred.withColumn("pred", F.udf(shifted, "double")("y"))
    rows = evaluation_report(pred).collect()
    assert made.value == 40
    assert {r.value for r in rows if r.section == "metrics" and r.key == "n"} == {40.0}


def test_unknown_keys_expand_each_user_once(spark, sf_dir, monkeypatch):
    seen = []

    def grid(requests, *args):
        seen.append(requests)
        return own(requests, *args)

    own = SV.request_grid
    monkeypatch.setattr(SV, "request_grid", grid)
    got = {r.uid_key for r in SQ.q_unknown_keys(spark, sf_dir).collect()}
    users = SQ.requests(spark, sf_dir).select("user_id").distinct().count()
    assert seen[0].count() == users < SQ.requests(spark, sf_dir).count()
    known = {r.uid for r in SQ.curated_export(spark, sf_dir).select("uid").distinct().collect()}
    assert got == {r.uid_key for r in SQ._grid(spark, sf_dir).select("uid_key").distinct().collect()} - known - {None}


def test_grid_and_roundtrip_score_their_pairs_once(spark, sf_dir):
    assert joins(SQ.q_prediction_grid(spark, sf_dir)) == 1
    # both heads join two key tables and the quantiles, and the results meet once (13 before)
    assert joins(EQ.q_model_roundtrip(spark, sf_dir)) == 7


def test_low_variance_items_reads_staged_steps_and_keeps_tasks_small(spark, sf_dir):
    """The windows over the steps run in writes of their own, in tasks of few shuffled bytes."""
    own, before = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), spark.conf.get(SK.TASK_BYTES, None)
    df = CQ.q_low_variance_items(spark, sf_dir)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "Window" not in out.getvalue()
    during = []

    class Probe:
        sparkSession = spark

        @property
        def write(self):
            during.append(spark.conf.get(SK.TASK_BYTES, None))
            return own.write

    assert SK.stage(Probe(), "probe", task_bytes="8m").count() == own.count()
    assert during == ["8m"] and spark.conf.get(SK.TASK_BYTES, None) == before

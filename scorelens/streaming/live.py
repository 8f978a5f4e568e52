"""Scoring a request stream with a model that changes (T1).

The key tables of a model are one published dataset (``sources.sinks.publish``), so users and
items of different models never meet.  Each micro-batch resolves the newest version when it
starts.  Requests whose user or item that version does not know are kept in a second sink and
tried again with each later batch; a request without a user or item can never be known and
is not kept.

A batch writes its scores to a folder of its own and then commits the waiting requests under
its id (``commit_batch``), which is the commit of both: readers see the scores of committed
batches only, and a batch that is run again after a crash writes the same folder or, once
committed, does nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, shared_path
from ..sources.sinks import delete_path, publish, versions
from .scoring import commit_batch, committed, score_requests

MODEL = "kind string, id bigint, years array<int>, speeds array<struct<speed:int,pred:double>>"


def publish_keys(years: DataFrame, speeds: DataFrame, path: str) -> None:
    """A new version of the key tables (``operators.serve.user_years``, ``item_speeds`` with ``pred``)."""
    def build():
        return (years.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "years")
                .unionByName(speeds.select(F.lit("item").alias("kind"), F.col("beatmap_id").alias("id"), "speeds"),
                             allowMissingColumns=True))
    publish(years.sparkSession, build, path, refresh=True, keep_previous=1)


def newest_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Years, speeds and generation of the newest version (empty tables, 0 if there is none)."""
    known = versions(spark, path)
    keys = spark.read.schema(MODEL).parquet(f"{path}/{known[0]['version']}") if known else spark.createDataFrame([], MODEL)
    return (keys.where("kind = 'user'").select(F.col("id").alias("user_id"), "years"),
            keys.where("kind = 'item'").select(F.col("id").alias("beatmap_id"), "speeds"),
            known[0]["generation"] if known else 0)


def _paths(spark: SparkSession, job: str) -> list[str]:
    return [shared_path(spark, "streams", job, x, unique=False) for x in ("scored", "waiting", "checkpoint")]


def score_batch(batch: DataFrame, batch_id: int, job: str, model_path: str) -> bool:
    """Score a micro-batch and the waiting requests; False if the batch is committed already."""
    spark = batch.sparkSession
    out, wait, _ = _paths(spark, job)
    if any(r["generation"] >= batch_id for r in versions(spark, wait)):
        return False
    years, speeds, generation = newest_keys(spark, model_path)
    todo_path = scratch_path(spark, "live")
    (batch.where(F.col("user_id").isNotNull() & F.col("beatmap_id").isNotNull())
     .unionByName(committed(spark, wait, batch.schema)).write.parquet(todo_path))
    todo = spark.read.schema(batch.schema).parquet(todo_path)
    (score_requests(todo, years, speeds).select(*batch.columns, "uid_key", "mid_key", "pred", F.lit(generation).alias("model"))
     .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
    no_user = todo.join(years, "user_id", "left_anti")
    no_item = todo.join(years, "user_id", "left_semi").join(speeds, "beatmap_id", "left_anti")
    done = commit_batch(no_user.unionByName(no_item).select(*batch.columns), batch_id, wait)
    delete_path(spark, todo_path)
    return done


def run_live(requests: DataFrame, job: str, model_path: str) -> None:
    """Drain the stream ``(.., user_id, beatmap_id)`` through ``score_batch``."""
    spark = requests.sparkSession
    q = (requests.writeStream.foreachBatch(lambda batch, i: score_batch(batch, i, job, model_path) and None)
         .option("checkpointLocation", _paths(spark, job)[2]).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def scored(spark: SparkSession, job: str, schema: T.StructType) -> DataFrame:
    """Scores of the committed batches; ``schema`` is that of the requests."""
    out, wait, _ = _paths(spark, job)
    fields = T.StructType([*schema.fields, T.StructField("uid_key", T.StringType()), T.StructField("mid_key", T.StringType()),
                           T.StructField("pred", T.DoubleType()), T.StructField("model", T.IntegerType()),
                           T.StructField("batch", T.LongType())])
    known = versions(spark, wait)
    try:
        rows = spark.read.schema(fields).parquet(out)
    except AnalysisException:  # no batch has run yet
        return spark.createDataFrame([], fields)
    return rows.where(F.col("batch") <= (known[0]["generation"] if known else -1))


def waiting(spark: SparkSession, job: str, schema: T.StructType) -> DataFrame:
    """Requests that no model so far knows."""
    return committed(spark, _paths(spark, job)[1], schema)

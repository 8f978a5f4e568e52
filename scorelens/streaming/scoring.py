"""Structured Streaming jobs: score a request stream against static tables
(T1) and keep a running count of predictions served (T2).

Both read the request table's files with the file source.  A job has a stable
name, and its output and checkpoint live under it in the shared folder, so a
restart resumes: it reads the files that were added and adds to the counts.
``trigger(availableNow=True)`` drains what is there and stops (a long-running
deployment uses a processing-time trigger instead).  The static side of the
stream-static joins is staged once, so micro-batches do not recompute it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_first
from ..operators import serve as SV
from ..session import shared_path
from ..sources.sinks import delete_path, versions


def request_stream(spark: SparkSession, table_path: str, schema,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Requests ``(event_id, user_id, beatmap_id, event_type, ts)`` of a table: one parquet
    file or a folder of them.  Without a limit a trigger takes all new files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # A pattern that matches just this path: the file source takes a plain path for a folder.
    path = table_path.rstrip("/")
    raw = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    k = json_first(F.concat(F.lit("["), F.col("props"), F.lit("]")), "struct<k:bigint>")["k"]
    return raw.select("event_id", F.col("user_id").cast("bigint").alias("user_id"),
                      k.alias("beatmap_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))


def score_requests(requests: DataFrame, years: DataFrame, speeds: DataFrame) -> DataFrame:
    """Stream-static joins: every known (year, speed) pair of each request with the
    prediction that ``speeds`` carries (``operators.serve.item_speeds``)."""
    return SV.truthy(SV.known_pairs(requests, years, speeds))


def prediction_counts(requests: DataFrame, years: DataFrame, speeds: DataFrame) -> DataFrame:
    """Running totals per request type: requests seen, predictions served.  A request's
    predictions are its user's years times its item's predicted speeds, so no pair is made."""
    n_years = years.select("user_id", F.size("years").alias("_y"))
    n_speeds = speeds.select("beatmap_id", F.size(F.filter(
        "speeds", lambda s: s["pred"].isNotNull() & (s["pred"] != 0))).alias("_s"))
    j = requests.join(n_years, "user_id", "left").join(n_speeds, "beatmap_id", "left")
    return j.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.coalesce(F.col("_y") * F.col("_s"), F.lit(0)).cast("bigint")).alias("n_predictions"))


def commit_batch(batch: DataFrame, batch_id: int, out: str) -> bool:
    """Make ``batch`` the table at ``out``, once: a batch id that is committed, or older than the
    committed one, changes nothing (False), as after a crash Spark runs the last batch again.
    The rows are a complete folder before one appended row makes it known, and the version
    before it stays for its readers."""
    spark = batch.sparkSession
    if any(r["generation"] >= batch_id for r in versions(spark, out)):
        return False
    version = f"v-{uuid.uuid4().hex[:12]}"
    batch.write.mode("errorifexists").parquet(f"{out}/{version}")
    (spark.range(1).selectExpr(f"'{version}' AS version", f"CAST({batch_id} AS INT) AS generation",
                               "current_timestamp() AS published_at")
     .write.mode("append").parquet(f"{out}/versions"))
    known = versions(spark, out)
    kept = {r["generation"] for r in known[:2]}
    for r in known:
        if r["generation"] not in kept:
            delete_path(spark, f"{out}/{r['version']}")
    return True


def committed(spark, out: str, schema) -> DataFrame:
    """The table of the newest committed batch (no rows if there is none)."""
    known = versions(spark, out)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/{known[0]['version']}")


def run_to_table(stream: DataFrame, job: str, output_mode: str = "append") -> DataFrame:
    """Drain the stream of the job named ``job`` into parquet under the shared folder and
    return the table so far (empty if nothing has arrived).

    ``append``: a file sink (exactly-once through its log).  ``complete``: each
    micro-batch's full result is a version of the table (``commit_batch``), for
    aggregates whose state lives in the checkpoint.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "streams", job, "table", unique=False)
    ckpt = shared_path(spark, "streams", job, "checkpoint", unique=False)
    if output_mode == "append":
        q = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            commit_batch(batch, batch_id, out)

        q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if output_mode != "append":
        return committed(spark, out, stream.schema)
    try:
        return spark.read.schema(stream.schema).parquet(out)
    except AnalysisException:  # no batch has run yet
        return spark.createDataFrame([], stream.schema)

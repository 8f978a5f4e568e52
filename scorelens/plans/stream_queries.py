"""Registered queries: streaming jobs (T1, T2) and sources / sinks (S4-S9,
S13).  Each streaming key's oracle is the batch SQL of the same computation
(stream = batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import fixed_sql
from ..operators.metric import scroll_variance
from ..session import shared_path
from ..sources import files, sinks
from ..sources.tables import TABLES, read_table, register_tables, table_path
from ..streaming import scoring as ST
from .curation import curated_name
from .curation_queries import CFG, stages
from .curation_queries import export as curated_export
from .curation_sql import with_curation
from .registry import register
from .serving_queries import _with_grid, serving_tables

def _job(spark, sf_dir, name: str) -> str:
    """A job's name: one for each source path and version of the curated data (the request
    table may grow; its files are not part of the name)."""
    return f"{name}_{curated_name(spark, sf_dir, CFG)}"


def _stream(spark, sf_dir):
    return ST.request_stream(spark, table_path(sf_dir, "events"), read_table(spark, sf_dir, "events").schema)


def _static(spark, sf_dir):
    return [sinks.stage(t, "serving") for t in serving_tables(spark, sf_dir)]


@register("stream_scoring", _with_grid(
    f"SELECT event_id, user_id, uid_key, mid_key, {fixed_sql('pred')} AS pred FROM scored"))
def q_stream_scoring(spark, sf_dir):
    """T1: request stream joined to the static key tables, every known (year, speed) pair
    scored (append sink)."""
    s = ST.score_requests(_stream(spark, sf_dir), *_static(spark, sf_dir))
    out = ST.run_to_table(s.select("event_id", "user_id", "uid_key", "mid_key", "pred"), _job(spark, sf_dir, "scoring"))
    return out.withColumn("pred", fixed(F.col("pred")))


@register("stream_prediction_count", _with_grid(
    "SELECT r.event_type, count(*) AS n_requests, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_predictions "
    "FROM requests r LEFT JOIN (SELECT event_id, count(*) AS n FROM scored GROUP BY event_id) s "
    "ON s.event_id = r.event_id GROUP BY r.event_type"))
def q_stream_prediction_count(spark, sf_dir):
    """T2: running counts per request type (stateful aggregate, complete mode)."""
    s = ST.prediction_counts(_stream(spark, sf_dir), *_static(spark, sf_dir))
    return ST.run_to_table(s, _job(spark, sf_dir, "prediction_count"), "complete")


@register("stream_model_scoring")
def q_stream_model_scoring(spark, sf_dir):
    """T1 with the factor model: the known (year, speed) pairs of each streamed request join
    the static key tables and go back to the accuracy scale."""
    from ..operators import model as MD
    from ..operators import serve as SV
    from .evaluation_queries import _trained
    from .serving_queries import MODEL_YEAR

    tr = _trained(spark, sf_dir)
    pairs = SV.known_pairs(_stream(spark, sf_dir), SV.user_years(tr.model.users, MODEL_YEAR), SV.item_speeds(tr.model.items))
    scored = MD.predict(tr.model, pairs.select("event_id", "uid_key", "mid_key"), "uid_key", "mid_key", on_unknown="drop")
    # a fit is new in every application, and so is the job that uses it
    job = f"{_job(spark, sf_dir, 'model_scoring')}_{spark.sparkContext.applicationId}"
    return ST.run_to_table(scored, job)


# ---------------------------------------------------------------- sources / sinks
@register("csv_roundtrip", with_curation("SELECT * FROM export"))
def q_csv_roundtrip(spark, sf_dir):
    """Export as headered CSV, read back with the explicit training schema."""
    e = curated_export(spark, sf_dir)
    path = sinks.write_csv(e, shared_path(spark, "export_csv"))
    return sinks.read_csv(spark, path, "mid string, uid string, accuracy float")


@register("export_dataset", with_curation("SELECT mid, uid, accuracy, 3 AS n_fields FROM export"))
def q_export_dataset(spark, sf_dir):
    """The exported text, written in parallel with a header line in each part: every line but
    the headers split by hand (no CSV reader) into ``mid,uid,accuracy``."""
    e = curated_export(spark, sf_dir)
    path = sinks.write_csv(e, shared_path(spark, "export_text"))
    f = F.split("value", ",")
    return spark.read.text(path).where(F.col("value") != ",".join(e.columns)).select(
        f[0].alias("mid"), f[1].alias("uid"), f[2].cast("float").alias("accuracy"), F.size(f).alias("n_fields"))


@register("tsv_roundtrip", "SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS username, "
          "c_mktsegment AS segment FROM customer")
def q_tsv_roundtrip(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("segment"))
    path = sinks.write_csv(c, shared_path(spark, "users_tsv"), sep="\t")
    return sinks.read_csv(spark, path, "user_id bigint, username string, segment string", sep="\t")


@register("materialize", with_curation("SELECT * FROM curated"))
def q_materialize(spark, sf_dir):
    """Replace-a-table: the curated scores published anew and read back; a reader of the
    table before keeps its copy."""
    path = shared_path(spark, "tables", curated_name(spark, sf_dir, CFG), "active_scores", unique=False)
    return sinks.publish(spark, lambda: stages(spark, sf_dir, export_stage_mode="none").curated, path,
                         refresh=True, keep_previous=1)


@register("key_files_scan", with_curation(
    f"SELECT e.mid, {fixed_sql('m.svness')} AS svness, "
    "e.mid IN (SELECT mid FROM metric_keys WHERE mid IN (SELECT mid FROM steps)) AS has_file "
    "FROM eligible e LEFT JOIN item_metric m ON e.mid = m.mid"))
def q_key_files_scan(spark, sf_dir):
    """One text file of ``offset,speed`` lines per active item, written from
    the step table and read back; every eligible item is a key, and keys
    without a file keep a NULL metric (``has_file`` reports them)."""
    st = stages(spark, sf_dir, stage_mode="none")
    active = sinks.stage(st.active_items.select("mid").distinct(), "key_files_items")
    path = shared_path(spark, "key_files")
    # Staged, so the shuffles of the items and steps are off the disk when the files come.
    written = sinks.stage(st_steps(spark, sf_dir).join(active, "mid", "left_semi"), "key_files_written")
    files.write_key_files(written, "mid", path, folders=False)
    # The files are opened once, for the metric and for the keys that have one.
    steps = sinks.stage(files.read_key_files(spark, path, "mid"), "key_files_steps")
    found = steps.select("mid").distinct().withColumn("has_file", F.lit(True))
    sv = scroll_variance(steps, "mid", stage_mode="table")
    return (st.eligible.join(sv, "mid", "left").join(found, "mid", "left")
            .select("mid", fixed(F.col("svness")).alias("svness"),
                    F.coalesce("has_file", F.lit(False)).alias("has_file")))


def st_steps(spark, sf_dir):
    from ..sources import fixture
    return fixture.steps(spark, sf_dir)


@register("table_by_name", "SELECT c_mktsegment AS segment, count(*) AS n_users FROM customer GROUP BY c_mktsegment")
def q_table_by_name(spark, sf_dir):
    """A table read by its name."""
    register_tables(spark, sf_dir, ["customer"])
    return spark.table("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_users"))


@register("preflight", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS readable, (SELECT count(*) > 0 FROM {t}) AS has_rows"
    for t in TABLES))
def q_preflight(spark, sf_dir):
    from ..sources.tables import preflight
    return preflight(spark, sf_dir)


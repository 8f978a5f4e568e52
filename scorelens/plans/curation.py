"""The curation job end to end (flagship) and its stage-by-stage funnel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CurationConfig, config_key
from ..operators import curate as C
from ..operators.metric import DEFAULT_ROWS_PER_BUCKET, STEPS_PER_TASK, item_metric
from ..sources.sinks import stage


@dataclass
class CurationStages:
    prepared: DataFrame
    eligible: DataFrame
    scored: DataFrame
    active_items: DataFrame
    active_users: DataFrame
    metric: DataFrame
    low_variance: DataFrame
    curated: DataFrame
    export: DataFrame


def curation_stages(scores: DataFrame, items: DataFrame, steps: DataFrame,
                    cfg: CurationConfig, stage_mode: str = "table",
                    rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET,
                    export_stage_mode: str | None = None) -> CurationStages:
    """Declare every stage.  ``item_scores`` feeds both activity counts and the
    final semi joins, so it is staged once (see ``sources.sinks.stage``); so is
    the exported training set."""
    prepared = C.prepare_scores(scores, cfg)
    eligible = C.eligible_items(items, cfg)
    scored = stage(C.item_scores(prepared, eligible), "item_scores", stage_mode)
    act_items = C.active_items(scored, cfg)
    act_users = C.active_users(scored, cfg)
    metric = item_metric(act_items, steps, "mid", rows_per_bucket, stage_mode)
    low_var = stage(C.low_variance_items(act_items, metric, cfg), "low_variance", stage_mode, STEPS_PER_TASK)
    curated = C.curated_scores(scored, low_var, act_users, cfg)
    # The export feeds every later job (fit, split, evaluation), which read it
    # several times each: it is written once, like the reference's dataset file.
    export = stage(C.export_dataset(curated), "export",
                   stage_mode if export_stage_mode is None else export_stage_mode)
    return CurationStages(prepared, eligible, scored, act_items, act_users, metric, low_var,
                          curated, export)


def curate(scores: DataFrame, items: DataFrame, steps: DataFrame, cfg: CurationConfig,
           stage_mode: str = "table") -> DataFrame:
    """``(mid "<mid>/<speed>", uid "<uid>/<year>", accuracy)`` rows that survive."""
    return curation_stages(scores, items, steps, cfg, stage_mode).export


def funnel(st: CurationStages, scores: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Row count after each stage, one row per stage (A14).  All scores and those in range
    come from one pass over the score log."""
    head = C.derived_columns(scores).select(F.stack(F.lit(2), *[x for name, c in (
        ("0_scores", F.lit(1)),
        ("1_accuracy_in_range", F.when(F.col("accuracy_320").between(cfg.acc_min, cfg.acc_max), 1))) for x in (F.lit(name), c)])
        .alias("stage", "hit")).groupBy("stage").agg(F.count("hit").alias("n_rows"))
    parts = [("2_eligible_items", st.eligible), ("3_item_scores", st.scored),
             ("4_active_items", st.active_items), ("5_active_users", st.active_users),
             ("6_low_variance_items", st.low_variance), ("7_curated", st.curated)]
    names = head.sparkSession.createDataFrame([("0_scores",), ("1_accuracy_in_range",)], "stage string")
    out = names.join(F.broadcast(head), "stage", "left").select("stage", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))
    for name, df in parts:
        out = out.unionByName(df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows"))
    return out


# Modules whose logic defines the curated dataset: their text enters its name,
# so a code change never reuses a dataset built by older logic.
_DEFINING = ("operators/curate.py", "operators/metric.py", "plans/curation.py",
             "sources/fixture.py", "functions/scores.py", "functions/curves.py", "config.py")


def code_hash() -> str:
    """md5 of the modules that define the curated dataset."""
    import hashlib
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = hashlib.md5()
    for rel in _DEFINING:
        with open(os.path.join(root, rel), "rb") as fh:
            code.update(fh.read())
    return code.hexdigest()


# Tables that the curated dataset is made of.
INPUT_TABLES = ("lineitem", "orders", "part")
MAX_LISTED = 10_000


def list_files(spark, path: str) -> list[tuple[str, int, int]] | None:
    """``(path, length, modification time)`` of a table's files by the cluster's own file
    system: no job and no file opened.  None without the JVM gateway or with more than
    ``MAX_LISTED`` files, which a job lists faster."""
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is None:
        return None
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            if len(out) == MAX_LISTED:
                return None
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark, paths: list[str]) -> str:
    """Hash of the files of several tables: a changed, added or removed file gives another."""
    import hashlib

    code = hashlib.md5()
    n = 0
    for i, path in enumerate(paths):
        files = list_files(spark, path)
        if files is None:
            # One row comes to the driver, however many files there are; no column is read.
            files = [tuple(spark.read.parquet(path).select(
                F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"),
                F.col("_metadata.file_modification_time").alias("m")).distinct()
                .agg(F.lit("job"), F.count(F.lit(1)), F.sum(F.xxhash64("p", "n", "m").cast("decimal(38,0)"))).first())]
        n += len(files)
        for f in files:
            code.update(f"{i}\x00{f[0]}\x00{f[1]}\x00{f[2]}\n".encode())
    return f"{n}:{code.hexdigest()}"


def input_fingerprint(spark, sf_dir: str, tables=INPUT_TABLES) -> str:
    """``fingerprint`` of the input tables."""
    from ..sources.tables import table_path

    return fingerprint(spark, [table_path(sf_dir, t) for t in tables])


def dataset_name(source: str, cfg: CurationConfig, inputs: str = "", code: str | None = None) -> str:
    """Name of the curated dataset: a readable tag of the source, then 8 hex digits each of
    the md5 of the whole source path and the inputs' fingerprint, of the parameters and of
    the code (see ``config.config_key``)."""
    return config_key(source, [*cfg.params(), cfg.user_key, cfg.playmode, cfg.key_counts],
                      code_hash() if code is None else code, inputs)


def curated_name(spark, sf_dir: str, cfg: CurationConfig) -> str:
    return dataset_name(sf_dir, cfg, input_fingerprint(spark, sf_dir))


def curated_dataset(spark, source: str, build, cfg: CurationConfig,
                    refresh: bool = False) -> DataFrame:
    """The curated export for ``source``: reused when a copy with the same name is
    published under the shared folder (``refresh`` recomputes and replaces it, and leaves
    the copy before it for its readers), else built and published."""
    from ..session import shared_path
    from ..sources.sinks import publish

    path = shared_path(spark, "datasets", curated_name(spark, source, cfg), unique=False)
    return publish(spark, build, path, refresh, keep_previous=1)

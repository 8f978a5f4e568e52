"""Session helpers: a configured SparkSession and the shared working folder.

Intermediate tables and streaming checkpoints go to the folder the cluster
names in ``spark.checkpoint.dir``.  A local session (tests, the bench) that
has none gets a fresh folder under the system temp dir; a cluster session
without it is an error, because a machine-local folder is not shared.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings every session of this library wants; cluster defaults win for the rest.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Local sessions (tests, bench) run everything in the driver JVM; its memory is the
# caller's choice (``extra``).
LOCAL_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "scorelens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so a job works from
    any folder and on machines that do not have the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_scorelens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="scorelens-code-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)  # Spark's own file server; the local copy is only its source
    sc._scorelens_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder; create a private one only for local sessions."""
    ship_package(spark)
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; a cluster run needs a shared folder for "
                "intermediate tables and streaming checkpoints")
        path = tempfile.mkdtemp(prefix="scorelens-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared folder; ``unique`` appends a fresh run id."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tail = list(parts) + ([uuid.uuid4().hex[:12]] if unique else [])
    return "/".join([base, *tail]) if "://" in base else os.path.join(base, *tail)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path for this application's intermediate tables:
    ``<shared>/stage/<application id>/<parts>/<run id>``."""
    return shared_path(spark, "stage", spark.sparkContext.applicationId, *parts)


def cleanup_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables (call when its jobs are
    done; published datasets and models live elsewhere and stay)."""
    from .sources.sinks import delete_path

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return delete_path(spark, f"{base}/stage/{spark.sparkContext.applicationId}")

"""Sinks: staging tables, overwrite writes, CSV/TSV export and read-back.

``stage`` replaces the reference's drop-and-recreate staging tables.  An
intermediate that several branches of one plan read is written once as parquet
under the shared folder (``spark.checkpoint.dir``) and read back, which cuts
the lineage (a lost executor re-reads the files instead of re-running the
joins) and lets every reader prune columns and push filters into the scan.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import scratch_path

STAGE_MODES = ("table", "persist", "none")


TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark, **conf):
    """The session has these settings within the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, mode: str = "table", task_bytes: str | None = None) -> DataFrame:
    """``task_bytes``: the most shuffled bytes that small partitions are put together to for one
    task of the write, where a row takes far more memory than it takes in the shuffle.  The write's
    own shuffle files go when it has ended, not when the driver happens to collect its garbage."""
    if mode == "none":
        return df
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode != "table":
        raise ValueError(f"stage mode must be one of {STAGE_MODES}")
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, **{DROP_SHUFFLES: "true"}, **({TASK_BYTES: task_bytes} if task_bytes else {})):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> str:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> str:
    """Headered delimited text without quoting, as the reference's export
    (values here are ids and numbers, so nothing needs quotes)."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
     .option("quoteAll", False).option("escapeQuotes", False).csv(path))
    return path


def read_csv(spark, path: str, schema, sep: str = ",") -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("mode", "FAILFAST").csv(path))


VERSIONS = "version string, generation int, published_at timestamp"


def delete_path(spark, path: str) -> bool:
    """Delete a folder through the cluster's own file system (the only use of the
    JVM gateway here); where there is no gateway the folder stays, False."""
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is None:
        return False
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def drop_staged(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            delete_path(t.sparkSession, path)


def versions(spark, path: str) -> list:
    """Published versions of a dataset, the current one first: the highest generation and
    in it the first to be published (one row for each publication)."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(VERSIONS).parquet(f"{path}/versions").collect()
    except AnalysisException:  # nothing published yet
        return []
    return sorted(rows, key=lambda r: (-r["generation"], r["published_at"], r["version"]))


def publish(spark, build, path: str, refresh: bool = False, keep_previous: int = 0) -> DataFrame:
    """The current version of the dataset at ``path``, built and published if there is
    none or ``refresh``.

    Each version is a folder of its own, complete before one appended row of
    ``<path>/versions`` makes it known, so there is no rename (object stores have none) and
    a failed build is never seen.  Of concurrent builders of one generation the first wins;
    the others delete their copy and read the winner's.  A refresh deletes versions older
    than the ``keep_previous`` latest before it."""
    import uuid

    known = versions(spark, path)
    if known and not refresh:
        return spark.read.parquet(f"{path}/{known[0]['version']}")
    version = f"v-{uuid.uuid4().hex[:12]}"
    with settings(spark, **{DROP_SHUFFLES: "true"}):
        build().write.mode("errorifexists").parquet(f"{path}/{version}")
    generation = known[0]["generation"] + 1 if known else 1
    (spark.range(1).selectExpr(f"'{version}' AS version", f"{generation} AS generation",
                               "current_timestamp() AS published_at")
     .write.mode("append").parquet(f"{path}/versions"))
    known = versions(spark, path)
    current = known[0]["version"]
    if current != version:
        delete_path(spark, f"{path}/{version}")
    else:
        for r in known:
            if r["generation"] < generation - keep_previous:
                delete_path(spark, f"{path}/{r['version']}")
    return spark.read.parquet(f"{path}/{current}")

"""One text file per key (the reference keeps one beatmap file per item).

``write_key_files`` lays a step table out as text files of ``offset,speed`` lines, ``<path>/<key>=<value>/*``
or, without folders, ``<path>/<value>.<task>.txt`` (half the disk blocks, where a key has a few lines).
``read_key_files`` reads either back as a step table with the key recovered from the name, and
``read_named_files`` reads a folder of ``<key>.<ext>`` files.  Keys without a file are the missing inputs: join
the requested keys with ``left`` to keep them with NULL metrics, or ``left_anti`` to list them.

In a folder that every machine has mounted (``file:``) the tasks make, list and open the files themselves:
Hadoop's local file system starts a process to set the mode of each file and writes a second one with its
checksum, and Spark's reader keeps the name and size of every file in the driver.  In other stores
Spark's writer and reader do it, always with folders.
"""

from __future__ import annotations

import os
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import DROP_SHUFFLES, SHUFFLE_PARTITIONS, TASK_BYTES, delete_path, settings

NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # as Spark names it
BLOCK = 1 << 20  # characters of a file that are one row on their way to the lines
HELD = 1000      # such rows held by a reading task
FILES_TASK = "4m"  # shuffled lines of a writing task: at some 30 lines a key, ten thousand files


def _local(spark: SparkSession, path: str) -> str | None:
    """``path`` as the machines have it mounted; None in another store or without the gateway."""
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is None:
        return None
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _quoted(value: str) -> str:
    """A key's value as the name of a file that is not hidden."""
    name = quote(value, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


def _writer(root: str, key: str, folders: bool):
    """Writes ``(key, line)`` rows that are sorted by key.  A file has its name when it is whole, the same
    for each attempt of the task."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        at, out, made = None, None, []

        def close():
            if out is not None:
                out.close()
                os.replace(*made[-1])

        for b in batches:
            runs, lines = pc.run_end_encode(b.column(0)), b.column(1).to_pylist()
            lo = 0
            for name, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                name = _quoted(name) if name else NO_KEY
                if out is None or name != at:
                    close()
                    at, last = name, f"part-{task:05d}.txt" if folders else f"{name}.{task:05d}.txt"
                    folder = f"{root}/{key}={name}" if folders else root
                    if folders:
                        os.makedirs(folder, exist_ok=True)
                    made[:] = [(f"{folder}/.{last}.{attempt}", f"{folder}/{last}")]
                    out = open(made[0][0], "w", encoding="utf-8", newline="\n")
                out.write("\n".join(lines[lo:hi]) + "\n")
                lo = hi
        close()
        yield from ()
    return run


def write_key_files(steps: DataFrame, key: str, path: str, folders: bool = True) -> str:
    spark = steps.sparkSession
    lines = steps.select(key, F.concat_ws(",", F.col("offset").cast("string"),
                                          F.col("speed").cast("string")).alias("value"))
    # A key's lines are gathered first, so there is a file per key and not one per key and
    # task; rebalance splits a hot key over several tasks, each with a file of its own.
    lines = lines.hint("rebalance", key)
    local = _local(spark, path)
    if local is None:
        # Tasks move their own files into place: the driver would move one key after the other.
        (lines.write.mode("overwrite").partitionBy(key)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))
        return path
    delete_path(spark, path)
    os.makedirs(local)
    lines = lines.select(F.col(key).cast("string").alias("name"), "value").sortWithinPartitions("name")
    with settings(spark, **{DROP_SHUFFLES: "true", TASK_BYTES: FILES_TASK}):
        lines.mapInArrow(_writer(local, key, folders), "n int").write.format("noop").mode("overwrite").save()
    return path


def _names(root: str):
    """Lists a folder."""
    def run(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        found = []
        with os.scandir(root) as entries:
            for e in entries:
                if not e.name.startswith((".", "_")) or e.name.startswith(NO_KEY):
                    found.append(e.name)
                if len(found) == 10_000:
                    yield pa.RecordBatch.from_pydict({"name": found})
                    found = []
        yield pa.RecordBatch.from_pydict({"name": pa.array(found, pa.string())})
    return run


def _reader(root: str, key: str):
    """``(key, text)`` of the files and of those in key folders: some whole lines in a row."""
    def files(name):
        if not os.path.isdir(f"{root}/{name}"):
            yield name.rsplit(".", 2)[0], f"{root}/{name}"
        elif name.startswith(f"{key}="):
            for e in os.scandir(f"{root}/{name}"):
                if not e.name.startswith((".", "_")):
                    yield name[len(key) + 1:], e.path

    def run(batches):
        import pyarrow as pa

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (keys, texts)], names=["key", "text"])

        keys, texts, size = [], [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                for value, path in files(name):
                    with open(path, encoding="utf-8", errors="replace") as f:
                        while lines := f.readlines(BLOCK):
                            keys.append(None if value == NO_KEY else unquote(value))
                            texts.append("".join(lines).removesuffix("\n"))
                            size += len(texts[-1])
                            if size > BLOCK or len(texts) == HELD:
                                yield batch()
                                keys, texts, size = [], [], 0
        yield batch()
    return run


def _steps(raw: DataFrame, key: str) -> DataFrame:
    parts = F.split("value", ",")
    return raw.select(F.expr(f"try_cast(`{key}` AS bigint)").alias(key),
                      parts[0].cast("bigint").alias("offset"),
                      parts[1].cast("double").alias("speed"))


def read_key_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    local = _local(spark, path)
    if local is None or not os.path.isdir(local):
        return _steps(spark.read.text(path), key)
    # The names are dealt out by number of files: they are a few bytes each and would be put together again.
    names = spark.range(0, 1, 1, 1).mapInArrow(_names(local), "name string")
    names = names.repartition(int(spark.conf.get(SHUFFLE_PARTITIONS)), "name")
    raw = names.mapInArrow(_reader(local, key), "key string, text string")
    return _steps(raw.select(F.col("key").alias(key), F.explode(F.split("text", "\n")).alias("value")), key)


def read_named_files(spark: SparkSession, path: str, key: str, ext: str = "csv") -> DataFrame:
    """Steps of a folder of ``<key>.<ext>`` files, the key taken from the file name (files of
    other names are not read)."""
    raw = spark.read.option("pathGlobFilter", f"*.{ext}").text(path)
    return _steps(raw.select("value", F.expr(f"substr(_metadata.file_name, 1, length(_metadata.file_name) - {len(ext) + 1})").alias(key)), key)


def missing_keys(keys: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The keys that have no file."""
    return keys.select(key).join(found.select(key).distinct(), key, "left_anti")

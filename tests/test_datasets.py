"""Dataset identity and publication, folder-form inputs, resumable streams, exports."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scorelens.config import FIXTURE_CURATION
from scorelens.plans.curation import curated_name, dataset_name
from scorelens.session import shared_path
from scorelens.sources import files, sinks
from scorelens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
Q = E.queries()


@pytest.fixture()
def copy(tmp_path):
    """The tables in a folder of their own, events and lineitem as folders of parts."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def as_folder(spark, sf_dir, table, parts, where="true"):
    df = spark.read.parquet(f"{SF}/{table}.parquet").where(where)
    os.unlink(f"{sf_dir}/{table}.parquet") if os.path.islink(f"{sf_dir}/{table}.parquet") else None
    df.repartition(parts).write.mode("append").parquet(f"{sf_dir}/{table}.parquet")


def test_names_differ_by_whole_path_and_inputs():
    cfg = FIXTURE_CURATION
    tail = "x" * 70
    names = {dataset_name(s, cfg, i, "code") for s, i in [
        ("/a/x-y", ""), ("/a/x/y", ""), (f"/one/{tail}", ""), (f"/two/{tail}", ""), ("/a/x-y", "1:2"), ("/a/x-y", "1:3")]}
    assert len(names) == 6
    assert dataset_name("/a/x-y/", cfg, "", "code") == dataset_name("/a/x-y", cfg, "", "code")


def test_changed_input_is_curated_again(spark, copy):
    before = Q["dataset_summary"](spark, copy).first().n_rows
    name = curated_name(spark, copy, FIXTURE_CURATION)
    os.unlink(f"{copy}/lineitem.parquet")
    as_folder(spark, copy, "lineitem", 3, "pmod(l_orderkey, 2) = 0")
    assert curated_name(spark, copy, FIXTURE_CURATION) != name
    after = Q["dataset_summary"](spark, copy).first().n_rows
    assert after < before == Q["dataset_summary"](spark, SF).first().n_rows
    assert after == Q["curate_dataset"](spark, copy).count()


def folders(path):
    return sorted(x for x in os.listdir(path) if x.startswith("v-"))


def test_publish_versions(spark):
    path = shared_path(spark, "published")
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))
    a = sinks.publish(spark, build, path)
    assert sinks.publish(spark, build, path).count() == 1 and len(built) == 1
    b = sinks.publish(spark, build, path, refresh=True, keep_previous=1)
    assert (a.count(), b.count()) == (1, 2) and len(folders(path)) == 2
    c = sinks.publish(spark, build, path, refresh=True)
    assert c.count() == 3 and len(folders(path)) == 1


def test_concurrent_builders_leave_one_copy(spark):
    path = shared_path(spark, "raced")

    def build():  # another builder publishes while this one builds
        sinks.publish(spark, lambda: spark.range(7), path)
        return spark.range(9)
    assert sinks.publish(spark, build, path).count() == 7
    assert len(folders(path)) == 1


def test_two_materialized_tables_live(spark):
    a = Q["materialize"](spark, SF)
    b = Q["materialize"](spark, SF)
    assert sorted(a.collect()) == sorted(b.collect()) != []


def test_streams_read_folders_and_resume(spark, copy):
    single = sorted(Q["stream_scoring"](spark, SF).collect())
    os.unlink(f"{copy}/events.parquet")
    as_folder(spark, copy, "events", 3, "event_id < 500")
    n_half = spark.read.parquet(f"{copy}/events.parquet").count()
    half = Q["stream_prediction_count"](spark, copy)
    assert half.agg(F.sum("n_requests")).first()[0] == n_half > 0
    assert Q["stream_scoring"](spark, copy).count() < len(single)
    as_folder(spark, copy, "events", 1, "event_id >= 500")
    whole = {r.event_type: (r.n_requests, r.n_predictions) for r in Q["stream_prediction_count"](spark, copy).collect()}
    assert whole == {r.event_type: (r.n_requests, r.n_predictions) for r in Q["stream_prediction_count"](spark, SF).collect()}
    assert sorted(Q["stream_scoring"](spark, copy).collect()) == single


def test_stream_without_files_is_empty(spark, tmp_path):
    from scorelens.streaming import scoring as ST
    os.makedirs(f"{tmp_path}/events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    out = ST.run_to_table(ST.request_stream(spark, f"{tmp_path}/events.parquet", schema), f"empty_{os.path.basename(tmp_path)}")
    assert out.count() == 0 and "beatmap_id" in out.columns


def test_export_is_written_in_parallel(spark):
    df = spark.range(1000).repartition(4).selectExpr("concat(id, '/0') mid", "concat(id, '/1') uid", "cast(id as float) accuracy")
    path = sinks.write_csv(df, shared_path(spark, "parallel_export"))
    parts = [x for x in os.listdir(path) if x.startswith("part-")]
    assert len(parts) == 4
    assert sinks.read_csv(spark, path, "mid string, uid string, accuracy float").count() == 1000


def test_files_named_by_key(spark, tmp_path):
    for name, text in (("7.csv", "0,1.0\n10,2.0\n"), ("8.csv", "5,1.5\n"), ("9.txt", "1,1\n"), ("x.csv", "2,2\n")):
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
    got = files.read_named_files(spark, str(tmp_path), "mid").collect()
    assert sorted(((r.mid or 0), r.offset, r.speed) for r in got) == [(0, 2, 2.0), (7, 0, 1.0), (7, 10, 2.0), (8, 5, 1.5)]
    keys = spark.createDataFrame([(7,), (8,), (11,)], "mid long")
    assert [r.mid for r in files.missing_keys(keys, files.read_named_files(spark, str(tmp_path), "mid"), "mid").collect()] == [11]


def test_key_files_are_one_for_each_key(spark, tmp_path):
    from scorelens.sources import files
    rows = [(k, o, float(o)) for k in (1, 2, 3) for o in range(40)]
    steps = spark.createDataFrame(rows, "mid bigint, offset bigint, speed double").repartition(6)
    path = files.write_key_files(steps, "mid", str(tmp_path / "keys"))
    assert [len(list((tmp_path / "keys" / f"mid={k}").glob("*.txt"))) for k in (1, 2, 3)] == [1, 1, 1]
    assert sorted(tuple(r) for r in files.read_key_files(spark, path, "mid").collect()) == rows


def test_key_files_without_folders_are_one_file_for_each_key(spark, tmp_path):
    """A key's file is the only thing that it puts on the disk: no folder, no checksum, no part of another try."""
    rows = [(k, o, float(o) / 3) for k in [*range(-300, 300), None] for o in range(7)]
    steps = spark.createDataFrame(rows, "mid bigint, offset bigint, speed double").repartition(6)
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "9999.00000.txt").write_text("1,1\n")  # of a table written before
    path = files.write_key_files(steps, "mid", str(tmp_path / "keys"), folders=False)
    found = list((tmp_path / "keys").iterdir())
    assert len(found) == 601 and all(f.is_file() and f.suffix == ".txt" for f in found)
    got = [tuple(r) for r in files.read_key_files(spark, path, "mid").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_key_files_of_a_hot_key_odd_names_and_none(spark, tmp_path):
    steps = spark.range(60_000).selectExpr("CASE WHEN id < 50000 THEN 'hot' ELSE concat('_a/b=', id % 3, '.') END AS k", "id AS offset", "id / 7D AS speed")
    for folders in (True, False):
        path = files.write_key_files(steps, "k", str(tmp_path / f"keys{folders}"), folders)
        raw = files.read_key_files(spark, path, "k")  # names that are no numbers give no key
        assert raw.count() == 60_000 and raw.where("k IS NOT NULL").isEmpty()
        assert raw.agg(F.sum("offset")).first()[0] == sum(range(60_000))
        assert sum(len(list((tmp_path / f"keys{folders}").rglob(x))) for x in ("*.crc", ".*.txt.*")) == 0
    path = files.write_key_files(steps.limit(0), "k", str(tmp_path / "none"), folders=False)
    assert files.read_key_files(spark, path, "k").isEmpty()


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in found.mkString("\n").split("\n") if x.endswith(".data") and "/shuffle_" in x}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """Its shuffle files go with the write; later reads take the table's files."""
    before = shuffle_files(spark)
    staged = sinks.stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "no_shuffles")
    for _ in range(100):  # they are deleted on the side
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert staged.count() == 100 and spark.conf.get(sinks.DROP_SHUFFLES, "false") == "false"

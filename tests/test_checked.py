"""Declared schemas, enforcement and quarantine; the dataset name's file list."""

from datetime import datetime

import pytest
from pyspark.sql import types as T

from scorelens.plans import curation
from scorelens.sources.checked import SCHEMAS, declared, enforce

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False),
                       T.StructField("x", T.DoubleType()), T.StructField("at", T.TimestampType())])
DAY = datetime(2020, 1, 1)
ROWS = [(1, "a", 1.0, DAY), (1, "a", 1.0, DAY), (1, "b", 0.5, None), (2, "a", None, None), (2, "a", None, None),
        (None, "a", 1.0, DAY), (None, "a", 1.0, DAY), (None, None, 1.0, DAY), (3, None, 9.0, DAY), (4, "z", 9.0, None),
        (4, "z", 0.0, None), (5, "n", float("nan"), None)]


def given(spark, rows=ROWS):
    free = T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMA.fields])
    return spark.createDataFrame(rows, free)


def test_every_row_is_good_or_in_quarantine_with_its_reason(spark):
    good, bad = enforce(given(spark), SCHEMA, ["id"], {"x": (0.0, 5.0)})
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a", 1.0, DAY), (2, "a", None, None), (4, "z", 0.0, None)]
    got = sorted((r.id or 0, r.name or "", r.copies, r.reason) for r in bad.collect())
    assert got == [(0, "", 1, "null id"), (0, "a", 2, "null id"), (1, "a", 1, "key"), (1, "b", 1, "key"), (2, "a", 1, "key"),
                   (3, "", 1, "null name"), (4, "z", 1, "range x"), (5, "n", 1, "range x")]
    assert sum(r[2] for r in got) + good.count() == len(ROWS)


def test_empty_and_clean_tables(spark):
    for rows in ([], ROWS[:1]):
        good, bad = enforce(given(spark, rows), SCHEMA, ["id"])
        assert good.count() == len(rows) and bad.count() == 0


def test_two_columns_as_key(spark):
    good, bad = enforce(given(spark), SCHEMA, ["id", "name"])
    assert good.count() == 5 and {r.reason for r in bad.collect()} == {"null id", "null name", "key"}


def test_wrong_types_raise_before_any_job(spark):
    df = given(spark).selectExpr("cast(id as string) id", "name", "x", "1 as other")
    with pytest.raises(TypeError, match="id: string, declared bigint; at: missing"):
        declared(df, SCHEMA)
    df = given(spark).selectExpr("1 as other", "at", "x", "name", "id")
    assert declared(df, SCHEMA).columns == SCHEMA.names
    assert set(SCHEMAS) == {"scores", "items", "steps", "item_scores"}


def test_no_window_and_no_nested_loop(spark):
    good, bad = enforce(given(spark), SCHEMA, ["id"], {"x": (0.0, None)})
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_file_list_needs_no_job(spark, tmp_path, monkeypatch):
    for t in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    path = [str(tmp_path / f"{t}.parquet") for t in ("a", "b")]
    files = curation.list_files(spark, path[0])
    assert files and all(p.endswith(".parquet") and n > 0 and m > 0 for p, n, m in files)
    before = curation.fingerprint(spark, path)
    assert curation.fingerprint(spark, path) == before
    assert curation.fingerprint(spark, path[::-1]) != before
    spark.range(1).write.mode("append").parquet(path[1])
    assert curation.fingerprint(spark, path) != before
    monkeypatch.setattr(curation, "MAX_LISTED", 1)
    assert curation.list_files(spark, path[1]) is None
    many = curation.fingerprint(spark, path)
    assert curation.fingerprint(spark, path) == many
    spark.range(1).write.mode("append").parquet(path[1])
    assert curation.fingerprint(spark, path) != many

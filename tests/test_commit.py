"""Commits of streaming results: replays change nothing, readers see whole tables."""

from scorelens.session import scratch_path
from scorelens.streaming.scoring import commit_batch, committed


def rows(df):
    return sorted(r.n for r in df.collect())


def test_replay_and_readers(spark):
    out = scratch_path(spark, "commits")

    def batch(*n):
        return spark.createDataFrame([(x,) for x in n], "n long").repartition(3)

    schema = batch(1).schema
    assert rows(committed(spark, out, schema)) == []
    assert commit_batch(batch(1, 2), 0, out)
    reader = committed(spark, out, schema)
    assert commit_batch(batch(3, 4, 5), 1, out)
    assert rows(reader) == [1, 2]  # the version before stays for its readers
    assert not commit_batch(batch(9), 1, out) and not commit_batch(batch(9), 0, out)
    assert rows(committed(spark, out, schema)) == [3, 4, 5]
    batch(7).write.parquet(f"{out}/v-stopped")  # a writer that died before its commit
    assert rows(committed(spark, out, schema)) == [3, 4, 5]
    assert commit_batch(batch(6), 2, out)
    assert rows(committed(spark, out, schema)) == [6]

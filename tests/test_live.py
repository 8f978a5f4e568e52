"""A stream scored by a model that is published anew between its batches."""

from scorelens.session import scratch_path
from scorelens.streaming import live as LV

REQUEST = "event_id long, user_id long, beatmap_id long"


def test_new_version_between_batches(spark):
    base = scratch_path(spark, "live_test")
    job, model = base.rstrip("/").split("/")[-1], f"{base}/model"

    def send(*rows):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{base}/requests")

    def keys(users, items):
        LV.publish_keys(spark.createDataFrame([(u, [2019, 2020]) for u in users], "user_id long, years array<int>"),
                        spark.createDataFrame([(m, [(0, p)]) for m, p in items.items()],
                                              "beatmap_id long, speeds array<struct<speed:int,pred:double>>"), model)

    def run():
        stream = spark.readStream.schema(REQUEST).parquet(f"{base}/requests")
        LV.run_live(stream, job, model)
        return state(stream.schema)

    def state(schema):
        return ({(r.event_id, r.uid_key, r.pred, r.model) for r in LV.scored(spark, job, schema).collect()},
                sorted(r.event_id for r in LV.waiting(spark, job, schema).collect()))

    def both_years(e, u, p, g):
        return {(e, f"{u}/{y}", p, g) for y in (2019, 2020)}

    send((0, 1, 10))
    assert run() == (set(), [0])  # nothing is published yet
    keys([1], {10: 0.5})
    send((1, 1, 10), (2, 2, 10), (3, 1, 11), (4, None, 10), (5, 1, None))
    first = both_years(0, 1, 0.5, 1) | both_years(1, 1, 0.5, 1)
    assert run() == (first, [2, 3])
    keys([1, 2], {10: 0.7, 11: 0.6})
    assert run() == (first, [2, 3])  # no new requests, no batch
    send((6, 1, 10))
    want = first | both_years(6, 1, 0.7, 2) | both_years(2, 2, 0.7, 2) | both_years(3, 1, 0.6, 2)
    assert run() == (want, [])
    again = spark.createDataFrame([(9, 1, 10)], REQUEST)
    assert not LV.score_batch(again, 2, job, model) and not LV.score_batch(again, 0, job, model)
    # scores of a batch that died before its commit are not seen
    again.selectExpr("*", "'1/2020' AS uid_key", "'10/0' AS mid_key", "0.1D AS pred", "2 AS model").write.parquet(
        f"{LV._paths(spark, job)[0]}/batch=3")
    assert state(again.schema) == (want, [])
    assert LV.score_batch(again, 3, job, model)
    assert state(again.schema) == (want | both_years(9, 1, 0.7, 2), [])

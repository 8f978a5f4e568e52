"""Factor model and two-branch head: gradients, save/load, unknown keys, training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.config import FIXTURE_CURATION, TrainConfig
from scorelens.operators import head as HD
from scorelens.operators import model as MD
from scorelens.plans.curation import curation_stages
from scorelens.plans.modeling import head_predictions, predict_head, train, train_two_branch
from scorelens.session import shared_path
from scorelens.sources import fixture


def test_head_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    d = 3
    p = HD.init_params(d, 1, 0.1) + rng.normal(0, 0.1, HD.n_params(d))
    zu, zm, y = rng.normal(size=(7, d)), rng.normal(size=(7, d)), rng.normal(size=7)
    g, _ = HD.grad_np(HD.unpack(p, d), zu, zm, y)

    def loss(q):
        out, _ = HD.forward_np(HD.unpack(q, d), zu, zm)
        return ((out - y) ** 2).mean()

    eps = 1e-6
    for i in rng.choice(len(p), 25, replace=False):
        e = np.zeros_like(p)
        e[i] = eps
        num = (loss(p + e) - loss(p - e)) / (2 * eps)
        assert abs(num - g[i]) < 1e-6 * max(1.0, abs(num)), i


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    st = curation_stages(fixture.scores(spark, sf_dir), fixture.items(spark, sf_dir),
                         fixture.steps(spark, sf_dir), FIXTURE_CURATION)
    return train(st.export, TrainConfig(max_iter=4))


def test_save_load_predicts_the_same(spark, trained):
    path = shared_path(spark, "test_model")
    MD.save(trained.model, path)
    loaded = MD.load(spark, path)
    rows = trained.table.rows.where(F.col("part") == "train").select("uid", "mid").distinct()
    a = MD.predict(trained.model, rows).withColumnRenamed("pred", "a")
    b = MD.predict(loaded, rows).withColumnRenamed("pred", "b")
    diff = a.join(b, ["uid", "mid"]).select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert diff == 0.0
    assert a.count() == rows.count()


def test_unknown_key_raises(spark, trained):
    pairs = spark.createDataFrame([("999999/1990", "1/0")], "uid string, mid string")
    with pytest.raises(ValueError):
        MD.predict(trained.model, pairs)
    kept = MD.predict(trained.model, pairs, on_unknown="null").collect()
    assert len(kept) == 1 and kept[0].pred is None
    assert MD.predict(trained.model, pairs, on_unknown="drop").count() == 0


def test_head_trains_and_scores(spark, trained):
    head = train_two_branch(trained, HD.HeadConfig(epochs=3, patience=5))
    log = HD.epoch_log(spark, head).orderBy("epoch").collect()
    assert len(log) == 3
    assert log[-1].train_loss < log[0].train_loss
    assert all(r.val_mae is not None for r in log)
    best = HD.best_epoch(HD.epoch_log(spark, head)).first()
    assert best.val_loss == min(r.val_loss for r in log)
    pred = head_predictions(trained, head, "val")
    n_val = trained.table.rows.where(F.col("part") == "val").count()
    assert pred.count() == n_val  # cold-start rows are kept with NULL
    ok = pred.where(F.col("pred").isNotNull()).agg(F.min("pred"), F.max("pred")).first()
    assert 0.0 < ok[0] <= ok[1] <= 1.0


def test_fit_on_train_keeps_every_row(spark, sf_dir):
    st = curation_stages(fixture.scores(spark, sf_dir), fixture.items(spark, sf_dir),
                         fixture.steps(spark, sf_dir), FIXTURE_CURATION)
    tr = train(st.export, TrainConfig(max_iter=2, fit_on="train"))
    assert tr.table.rows.count() == st.export.count()
    assert tr.table.rows.where(F.col("part") == "train").where(F.col("uid_le").isNull()).count() == 0
    pred = MD.predict(tr.model, tr.table.rows.where(F.col("part") == "val").select("uid", "mid"),
                      on_unknown="null")
    assert pred.count() == tr.table.rows.where(F.col("part") == "val").count()


def test_model_stream_equals_batch(spark, sf_dir):
    import __spark_entry__ as E
    from scorelens.operators import serve as SV
    from scorelens.plans.evaluation_queries import _trained
    from scorelens.plans.serving_queries import MODEL_YEAR, requests
    s = E.queries()["stream_model_scoring"](spark, sf_dir)
    tr = _trained(spark, sf_dir)
    pairs = SV.known_pairs(requests(spark, sf_dir), SV.user_years(tr.model.users, MODEL_YEAR), SV.item_speeds(tr.model.items))
    b = MD.predict(tr.model, pairs.select("event_id", "uid_key", "mid_key"), "uid_key", "mid_key")
    j = s.alias("s").join(b.alias("b"), ["event_id", "uid_key", "mid_key"])
    assert j.count() == s.count() == b.count() > 0
    assert j.where(~F.col("s.pred").eqNullSafe(F.col("b.pred")) | F.col("s.pred").isNull()).count() == 0


def test_null_keys_raise_and_known_keys_are_never_null(spark, trained):
    pairs = spark.createDataFrame([("1/2000", None)], "uid string, mid string")
    with pytest.raises(ValueError, match="NULL"):
        MD.predict(trained.model, pairs.withColumn("uid", F.lit(trained.model.users.first().label)))
    assert MD.predict(trained.model, pairs, on_unknown="null").first().pred is None
    assert MD.predict(trained.model, pairs, on_unknown="drop").count() == 0
    for part in ("train", "test", "val"):
        rows = trained.table.rows.where(F.col("part") == part).select("uid", "mid")
        s = MD.summary(MD.predict(trained.model, rows, cold="cold")).first()
        assert s.n_rows == rows.count() and s.n_null == 0 and (part != "train" or s.n_cold == 0)


def errors_against_mean(tr, head):
    out = {}
    mean = tr.table.rows.where(F.col("part") == "train").select(F.avg(F.col("accuracy").cast("double"))).scalar()
    for part in ("train", "val"):
        rows = tr.table.rows.where(F.col("part") == part).select("uid", "mid", F.col("accuracy").cast("double").alias("a"))
        pred = predict_head(tr, head, MD.predict(tr.model, rows), out="h").withColumn("m", mean)
        r = pred.agg(*[f.alias(f"{k}_{c}") for c in ("pred", "h", "m") for k, f in (
            ("mae", F.avg(F.abs(F.col(c) - F.col("a")))), ("rmse", F.sqrt(F.avg((F.col(c) - F.col("a")) ** 2))))]).first()
        out[part] = r
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_model_is_as_good_as_the_mean(spark, scale):
    import __spark_entry__  # noqa: F401
    from scorelens.plans.evaluation_queries import _head, _trained
    d = f"/root/testdata/{scale}"
    for part, r in errors_against_mean(_trained(spark, d), _head(spark, d)).items():
        for c in ("pred", "h"):
            assert r[f"rmse_{c}"] <= 1.01 * r.rmse_m and r[f"mae_{c}"] <= 1.02 * r.mae_m, (part, r)


def test_biases_find_a_signal_and_noise_gives_none(spark):
    import random
    rng = random.Random(2)
    item = [rng.gauss(0, 1) for _ in range(30)]
    rows = [(u, i, item[i] + rng.gauss(0, 0.3)) for u in range(60) for i in rng.sample(range(30), 10)]
    df = spark.createDataFrame(rows, "u int, i int, y double")
    found = {r.i: r.bias for r in MD.shrunk_means(df, "i", F.col("y")).collect()}
    assert np.corrcoef([found[i] for i in range(30)], item)[0, 1] > 0.98
    assert max(abs(r.bias) for r in MD.shrunk_means(df.withColumn("y", F.rand(5) - 0.5), "u", F.col("y")).collect()) < 0.3
    assert MD.shrunk_means(df.limit(0), "u", F.col("y")).count() == 0


def test_head_does_not_depend_on_arrow_batches(spark, trained):
    out = []
    for n in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        out.append(train_two_branch(trained, HD.HeadConfig(epochs=2, batch_size=16)).params)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert np.allclose(out[0], out[1], rtol=1e-9)


def test_head_predict_unknown_keys(spark, trained):
    from scorelens.plans.modeling import predict_head
    head = train_two_branch(trained, HD.HeadConfig(epochs=1))
    known = trained.table.rows.where(F.col("part") == "train").select("uid", "mid").limit(5)
    unknown = spark.createDataFrame([("999999/1990", "1/0")], "uid string, mid string")
    assert predict_head(trained, head, known).where(F.col("pred").isNull()).count() == 0
    with pytest.raises(ValueError):
        predict_head(trained, head, unknown)
    assert predict_head(trained, head, unknown, on_unknown="drop").count() == 0
    assert predict_head(trained, head, unknown, on_unknown="null").first().pred is None

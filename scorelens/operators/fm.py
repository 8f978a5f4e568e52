"""Factorisation machine on one-hot ids (M6b), and the choice between models.

The composite keys are taken apart into four fields (user, year, item, speed), so what a
user's years or an item's speeds share is learned once, and a key that was never trained
still has the weights of its parts.  Features are hashed to ``2 ** bits`` places
(``FeatureHasher``, JVM-side): the model has ``2 ** bits * (factors + 1)`` numbers however
many ids there are, which bounds what each gradient step sends between tasks and driver.  Ids that collide share
their weights and spoil each other's interactions, so ``bits`` should leave most places empty.
Rows are never collected; a step is one tree aggregation over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import FeatureHasher
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import key_part
from ..sources.sinks import stage

FIELDS = ("user", "year", "item", "speed")


@dataclass(frozen=True)
class FMConfig:
    bits: int = 16
    factors: int = 4
    max_iter: int = 50
    step: float = 0.05
    reg: float = 1.0  # decoupled weight decay; 3 diverged on the test scores, 1e-4 learned their noise
    init_std: float = 0.1
    seed: int = 373


@dataclass
class FMModel:
    fitted: FMRegressionModel
    cfg: FMConfig


def features(rows: DataFrame, cfg: FMConfig, uid: str = "uid", mid: str = "mid") -> DataFrame:
    """``rows`` with the sparse vector ``features``: one place for each field."""
    parts = {"user": key_part(uid, 1), "year": key_part(uid, 2), "item": key_part(mid, 1), "speed": key_part(mid, 2)}
    hasher = FeatureHasher(inputCols=[f"_{f}" for f in FIELDS], categoricalCols=[f"_{f}" for f in FIELDS],
                           numFeatures=1 << cfg.bits, outputCol="features")
    return hasher.transform(rows.withColumns({f"_{f}": parts[f] for f in FIELDS})).drop(*[f"_{f}" for f in FIELDS])


def fit(rows: DataFrame, cfg: FMConfig = FMConfig(), target: str = "y") -> FMModel:
    """Fit on the rows that have both keys and a target."""
    whole = rows.where(F.col("uid").isNotNull() & F.col("mid").isNotNull() & F.col(target).isNotNull())
    hashed = stage(features(whole, cfg).select("features", F.col(target).cast("double").alias("label")), "fm_rows")
    fm = FMRegressor(factorSize=cfg.factors, maxIter=cfg.max_iter, stepSize=cfg.step, regParam=cfg.reg,
                     initStd=cfg.init_std, seed=cfg.seed, solver="adamW")
    return FMModel(fm.fit(hashed), cfg)


def predict(model: FMModel, pairs: DataFrame, uid: str = "uid", mid: str = "mid", out: str = "pred") -> DataFrame:
    """One row per pair with the normalised score; NULL where a key is NULL."""
    scored = model.fitted.setPredictionCol("_fm").transform(features(pairs, model.cfg, uid, mid))
    return scored.select(*pairs.columns, F.when(F.col(uid).isNotNull() & F.col(mid).isNotNull(), F.col("_fm")).alias(out))


def compare(predictions: dict[str, DataFrame]) -> DataFrame:
    """``(model, part, n, finite, mse, chosen)`` from each model's ``(part, y, pred)``: rows,
    finite predictions, their mean squared error, and whether the model has the smallest on
    the part ``val`` (of equal ones the first name)."""
    rows = None
    for name, p in predictions.items():
        p = p.select(F.lit(name).alias("model"), "part", F.col("y").cast("double").alias("y"), F.col("pred").cast("double").alias("pred"))
        rows = p if rows is None else rows.unionByName(p)
    finite = F.col("pred").isNotNull() & ~F.isnan("pred") & (F.abs("pred") < float("inf"))
    table = stage(rows.groupBy("model", "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("finite"),
        F.avg(F.when(finite, (F.col("y") - F.col("pred")) ** 2)).alias("mse")), "model_choice")
    best = table.where((F.col("part") == "val") & F.col("mse").isNotNull()).agg(F.min_by("model", F.struct("mse", "model"))).first()[0]
    return table.withColumn("chosen", F.col("model") == F.lit(best))

"""Train / evaluate jobs built from the operators (C3 + M6, C4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import head as HD
from ..operators import model as MD
from ..sources.sinks import stage
from .training import TrainingTable, training_table


@dataclass
class Trained:
    table: TrainingTable
    model: MD.FactorModel


def train(export: DataFrame, cfg: TrainConfig = TrainConfig(), stage_mode: str = "table") -> Trained:
    """Split, transform, codes and training rows, then the factor model on the train part."""
    tt = training_table(export, cfg, stage_mode)
    return Trained(tt, MD.fit(tt.rows, tt.quantiles, tt.uid_codes, tt.mid_codes, cfg, part="train"))


def holdout_predictions(tr: Trained, part: str = "val", cold: str | None = None) -> DataFrame:
    """Predictions for one part of the split with the truth on both scales."""
    rows = tr.table.rows.where(F.col("part") == part).select("mid", "uid", "accuracy")
    pred = MD.predict(tr.model, rows, on_unknown="null", cold=cold)
    return pred.select("mid", "uid", F.col("accuracy").cast("double").alias("y"), "pred", *([cold] if cold else []))


def evaluation_report(pred: DataFrame) -> DataFrame:
    """Metrics, errors and counts by truth bin, and 25-bin histograms of truth and prediction
    as one long table ``(section, key, value)``; rows without a prediction are counted.  The
    predictions feed every section and are written once."""
    pred = stage(pred.select("y", "pred"), "evaluated")

    def long(df, section, key, cols):
        return df.select(F.lit(section).alias("section"), F.explode(F.array(*[
            F.struct(key(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("section", "x.*")

    out = long(EV.regression_metrics(pred, "y", "pred"), "metrics", F.lit, ("n", "mae", "rmse", "r2", "r2_swapped"))
    out = out.unionByName(long(pred.agg(F.count_if(F.col("pred").isNull()).alias("n_without_prediction")), "metrics", F.lit, ("n_without_prediction",)))
    bins = EV.error_by_bin(pred, "y", "pred")
    for c in ("mae", "rmse", "n"):
        out = out.unionByName(long(bins, f"{c}_by_bin", lambda _: F.col("bound"), (c,)))
    both = pred.select(F.explode(F.array(
        F.struct(F.lit("histogram_truth").alias("series"), F.col("y").alias("x")),
        F.struct(F.lit("histogram_pred").alias("series"), F.col("pred").alias("x")))).alias("s")).select("s.*")
    hist = EV.histograms(both, ["histogram_truth", "histogram_pred"], 25)
    return out.unionByName(hist.select(F.col("series").alias("section"), F.col("bin").cast("string").alias("key"),
                                       F.col("count").cast("double").alias("value")))


def _head_rows(tr: Trained, pairs: DataFrame, uid_col: str, mid_col: str, on_unknown: str) -> DataFrame:
    """``pairs`` with both factor arrays (zeros for a known key without factors) and ``_base``."""
    j = MD.keyed(tr.model, pairs, uid_col, mid_col, on_unknown)
    zero = F.array_repeat(F.lit(0.0).cast("float"), tr.model.params["rank"])
    return j.select(*pairs.columns, MD.base_value(tr.model).alias("_base"), "_cold",
                    F.when(F.col("_known"), F.coalesce("_uf", zero)).alias("eu"), F.when(F.col("_known"), F.coalesce("_mf", zero)).alias("em"))


def train_two_branch(tr: Trained, cfg=None):
    """Fit the two-branch head (``operators.head``) on what the biases leave.  Its training
    rows are the slice that the factors were not fitted on, so it sees factors as they are
    for new pairs."""
    rows = tr.table.rows.where(F.col("part").isin("train", "val")).select("uid", "mid", "y", "part", "accuracy")
    rows = rows.where((F.col("part") == "val") | MD.held_out(tr.model.params["seed"]))
    rows = _head_rows(tr, rows, "uid", "mid", "drop").withColumn("y", F.col("y") - F.col("_base"))
    return HD.train_head(rows, cfg or HD.HeadConfig(), quantiles=tr.table.quantiles)


def predict_head(tr: Trained, head, pairs: DataFrame, uid_col: str = "uid", mid_col: str = "mid",
                 out: str = "pred", on_unknown: str = "error", cold: str | None = None) -> DataFrame:
    """Score ``(uid key, mid key)`` rows with the two-branch head: keys, forward pass, inverse
    transform.  ``on_unknown`` as in ``operators.model.predict``."""
    rows = _head_rows(tr, pairs, uid_col, mid_col, on_unknown)
    z = HD.forward(rows, head, "_z").withColumn("_z", F.col("_base") + F.col("_z"))
    back = FT.inverse(z, "_z", tr.model.quantiles, out)
    return back.select(*pairs.columns, MD.shifted(F.col(out), head.offset, tr.model.quantiles).alias(out),
                       *([F.col("_cold").alias(cold)] if cold else []))


def head_predictions(tr: Trained, head, part: str = "val") -> DataFrame:
    """Holdout rows scored by the head, back on the accuracy scale."""
    rows = tr.table.rows.where(F.col("part") == part).select("uid", "mid", "accuracy")
    pred = predict_head(tr, head, rows, on_unknown="null")
    return pred.select("mid", "uid", F.col("accuracy").cast("double").alias("y"), "pred")

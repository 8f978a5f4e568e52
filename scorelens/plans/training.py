"""Training table (C3): normalised target, id codes and the exact split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..operators import features as FT
from ..sources.sinks import stage


@dataclass
class TrainingTable:
    rows: DataFrame            # mid, uid, accuracy, y, uid_le, mid_le, part
    quantiles: FT.QuantileModel
    uid_codes: DataFrame       # label, code
    mid_codes: DataFrame


def training_table(export: DataFrame, cfg: TrainConfig = TrainConfig(), stage_mode: str = "table") -> TrainingTable:
    """``export`` is the curated ``(mid, uid, accuracy)`` set.  With ``fit_on='all'`` (the
    reference) the transform and the encoders see every row before the split; with
    ``'train'`` only the training part.  The split and the codes feed several joins and are
    staged once, like the rows that a fit iterates over."""
    split = stage(FT.exact_split(export, cfg.split, cfg.seed), "split", stage_mode)
    fit_rows = split if cfg.fit_on == "all" else split.where(F.col("part") == "train")
    qm = FT.fit_quantiles(fit_rows, "accuracy", cfg.n_quantiles)
    c = FT.label_codes_many(fit_rows, ["uid", "mid"])
    codes = stage(c["uid"].select(F.lit("uid").alias("kind"), "label", "code")
                  .unionByName(c["mid"].select(F.lit("mid").alias("kind"), "label", "code")), "codes", stage_mode)
    uid_codes = codes.where(F.col("kind") == "uid").select("label", "code")
    mid_codes = codes.where(F.col("kind") == "mid").select("label", "code")
    # left: with fit_on="train" a val/test key unseen in training keeps a NULL
    # code (a cold-start row) instead of vanishing
    rows = FT.encode(split, "uid", uid_codes, "uid_le", "left")
    rows = FT.encode(rows, "mid", mid_codes, "mid_le", "left")
    # after the joins, which then do not shuffle it
    rows = FT.normalize(rows, "accuracy", qm, "y")
    rows = rows.select("mid", "uid", "accuracy", "y", "uid_le", "mid_le", "part")
    return TrainingTable(stage(rows, "training_rows", stage_mode), qm, uid_codes, mid_codes)

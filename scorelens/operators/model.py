"""Factor model: fit, predict, save, load.

A pair's value on the normalised scale is ``mean + user bias + item bias + shrink * <user
factors, item factors>``.  The biases are grouped means, shrunk by the share of variance
that lies between the groups (none: all biases are zero).  The factors are Spark ML ALS
factors of what the biases leave (rank 6 by default), fitted without a seeded slice of the
training rows; on that slice ``shrink`` is the least-squares weight of their product, from 0
to 1, so factors that only memorise noise get no weight.  Factors stay distributed.

``fit`` joins each label to its code, bias and factors once; scoring is one join per side on
the label, never a driver-side lookup.  A known key without training rows or factors falls
back on the mean and on what is known of the other side, so every known key has a
prediction.  Predictions go back to the accuracy scale through the inverse quantile
transform, which makes a mean a median; ``offset``, the mean of the training rows' errors,
makes them means again (within the target's range).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..sources.sinks import drop_staged, stage
from . import features as FT

HELD = 10  # one training row in so many weighs the factors and does not fit them
BLOCK_ROWS = 1_000_000  # training rows for each block of the factorisation, which is one task


@dataclass
class FactorModel:
    users: DataFrame   # label, code, bias, n (training rows, NULL if none), emb (NULL if no factors)
    items: DataFrame
    mean: float
    shrink: float
    quantiles: FT.QuantileModel
    params: dict
    offset: float = 0.0

    @property
    def user_factors(self) -> DataFrame:
        """``(code, emb array<float>)`` per user key that has factors."""
        return self.users.where(F.col("emb").isNotNull()).select("code", "emb")

    @property
    def item_factors(self) -> DataFrame:
        return self.items.where(F.col("emb").isNotNull()).select("code", "emb")

    @property
    def uid_codes(self) -> DataFrame:
        return self.users.select("label", "code")

    @property
    def mid_codes(self) -> DataFrame:
        return self.items.select("label", "code")


def held_out(seed: int):
    """Rows of the slice that the factors are not fitted on."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("held"), "uid", "mid"), F.lit(HELD)) == 0


def als_blocks(n: int) -> int:
    """Blocks of the factorisation of ``n`` rows."""
    return max(2, min(n // BLOCK_ROWS + 1, 1000))


def shrunk_means(rows: DataFrame, key: str, value) -> DataFrame:
    """``(key, bias, n)``: group means of ``value`` shrunk towards zero by n / (n + k), where k
    is the variance within groups over the variance between them (method of moments)."""
    # The groups are summed once, for their variance and for the result.
    per = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("ss")), "groups")
    a = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).first()
    k, n = a["k"], a["n"] or 0
    ratio = None
    if k > 1 and n > k:
        within = max(a["ss"] - a["b"], 0.0) / (n - k)
        between = (a["b"] - a["s"] ** 2 / n) / (k - 1)
        size = (n - a["nn"] / n) / (k - 1)
        spread = (between - within) / size if size > 0 else 0.0
        ratio = within / spread if spread > 0 else None
    bias = F.lit(0.0) if ratio is None else F.col("s") / (F.col("n") + F.lit(float(ratio)))
    return per.select(key, bias.alias("bias"), "n")


def fit(rows: DataFrame, quantiles: FT.QuantileModel, uid_codes: DataFrame, mid_codes: DataFrame,
        cfg: TrainConfig = TrainConfig(), part: str = "train") -> FactorModel:
    """Fit on the rows of ``part`` (``None``: all rows).  ``rows`` is a
    training table (``uid``, ``mid``, ``uid_le``, ``mid_le``, ``y``)."""
    train = rows if part is None else rows.where(F.col("part") == part)
    size = train.agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    mean = float(size["mean"] or 0.0)
    # Codes and numbers go through the joins; the labels stay in the code tables.
    scored = ["accuracy"] if "accuracy" in rows.columns else []
    train = train.select(F.col("uid_le").cast("int"), F.col("mid_le").cast("int"), "y", held_out(cfg.seed).alias("held"), *scored)
    items = shrunk_means(train, "mid_le", F.col("y") - mean)
    rest = stage(train.join(items.select("mid_le", "bias"), "mid_le").select(
        "uid_le", "mid_le", (F.col("y") - mean - F.col("bias")).alias("r"), "held", *scored), "item_residuals")
    users = shrunk_means(rest, "uid_le", F.col("r"))
    by_item, rest = rest, stage(rest.join(users.select("uid_le", "bias"), "uid_le").select(
        "uid_le", "mid_le", (F.col("r") - F.col("bias")).cast("float").alias("r"), "held", *scored), "residuals")
    drop_staged(by_item)
    blocks = cfg.n_blocks or als_blocks(size["n"])
    als = ALS(rank=cfg.rank, maxIter=cfg.max_iter, regParam=cfg.reg_param,
              userCol="uid_le", itemCol="mid_le", ratingCol="r", nonnegative=False,
              implicitPrefs=False, coldStartStrategy="nan", seed=cfg.seed,
              numUserBlocks=blocks, numItemBlocks=blocks,
              checkpointInterval=5, intermediateStorageLevel="MEMORY_AND_DISK",
              finalStorageLevel="MEMORY_AND_DISK")
    model = als.fit(rest.where(~F.col("held")).select("uid_le", "mid_le", "r"))

    def table(codes, bias, key, factors):
        f = factors.select(F.col("id").alias("code"), F.col("features").alias("emb"))
        return stage(codes.select("label", F.col("code").cast("int"))
                     .join(bias.select(F.col(key).cast("int").alias("code"), "bias", "n"), "code", "left")
                     .join(f, "code", "left")
                     .select("label", F.col("code").cast("bigint").alias("code"),
                             F.coalesce("bias", F.lit(0.0)).alias("bias"), "n", "emb"), f"model_{key}")

    u = table(uid_codes, users, "uid_le", model.userFactors)
    m = table(mid_codes, items, "mid_le", model.itemFactors)
    drop_staged(users, items)
    # One join per side on the code, for the weight of the factors and for the errors.
    pairs = rest if scored else rest.where("held")
    for t, key, bias, emb in ((m, "mid_le", "_mb", "_mf"), (u, "uid_le", "_ub", "_uf")):
        pairs = pairs.join(t.select(F.col("code").cast("int").alias(key), F.col("bias").alias(bias), F.col("emb").alias(emb)), key)
    pairs = stage(pairs.select("r", "held", (F.lit(mean) + F.col("_ub") + F.col("_mb")).alias("base"), _dot(cfg.rank).alias("d"), *scored), "fitted")
    drop_staged(rest)
    w = pairs.where("held").agg(F.sum(F.col("r") * F.col("d")).alias("rd"), F.sum(F.col("d") * F.col("d")).alias("dd")).first()
    shrink = min(max(w["rd"] / w["dd"], 0.0), 1.0) if w["dd"] else 0.0
    model.userFactors.unpersist()
    model.itemFactors.unpersist()
    params = {"rank": cfg.rank, "max_iter": cfg.max_iter, "reg_param": cfg.reg_param,
              "seed": cfg.seed, "fit_part": part, "n_quantiles": quantiles.n, "mean": mean, "shrink": shrink}
    out = FactorModel(u, m, mean, shrink, quantiles, params)
    if scored:
        z = F.col("base") + F.lit(shrink) * F.coalesce(F.col("d"), F.lit(0.0))
        back = FT.inverse(pairs.select("accuracy", z.alias("_z")), "_z", quantiles, "pred")
        err = back.agg(F.avg(F.col("accuracy").cast("double") - shifted(F.col("pred"), 0.0, quantiles))).first()[0]
        out.offset = params["offset"] = float(err or 0.0)
    drop_staged(pairs)
    return out


def shifted(pred, offset: float, quantiles: FT.QuantileModel):
    """A prediction with its offset, within the target's range."""
    lo, hi = float(quantiles.quantiles[0]), float(quantiles.quantiles[-1])
    return F.when(pred.isNotNull(), F.least(F.greatest(pred + F.lit(offset), F.lit(lo)), F.lit(hi)))


def _dot(rank: int):
    """The dot product term by term (left to right from 0.0): plain arithmetic stays inside
    whole-stage codegen, where aggregate/zip_with would be interpreted."""
    dot = F.lit(0.0)
    for i in range(rank):
        dot = dot + F.col("_uf")[i].cast("double") * F.col("_mf")[i].cast("double")
    return dot


def keyed(model: FactorModel, pairs: DataFrame, uid_col: str, mid_col: str, on_unknown: str) -> DataFrame:
    """``pairs`` with ``_ub, _mb`` (biases), ``_uf, _mf`` (factors or NULL), ``_known`` and
    ``_cold`` (a key without training rows): one join per side on the label.

    ``on_unknown``: ``"error"`` raises ValueError if a key is NULL or not in the model,
    ``"null"`` keeps the row with ``_known`` false, ``"drop"`` removes it.  Rows with a NULL
    key go around the joins."""
    if on_unknown not in ("error", "null", "drop"):
        raise ValueError("on_unknown must be error, null or drop")
    if on_unknown == "error":
        FT.check_known(pairs, {uid_col: model.users, mid_col: model.items})
    how = "left" if on_unknown == "null" else "inner"
    whole = F.col(uid_col).isNotNull() & F.col(mid_col).isNotNull()

    def side(table, col, a, b, n, k):
        return table.select(F.col("label").alias(col), F.col("bias").alias(a), F.col("emb").alias(b), F.col("n").alias(n), F.lit(True).alias(k))

    out = (pairs.where(whole).join(side(model.users, uid_col, "_ub", "_uf", "_un", "_uk"), uid_col, how)
           .join(side(model.items, mid_col, "_mb", "_mf", "_mn", "_mk"), mid_col, how))
    known = F.col("_uk").isNotNull() & F.col("_mk").isNotNull()
    out = out.select(*pairs.columns, "_ub", "_mb", "_uf", "_mf", known.alias("_known"),
                     (F.col("_un").isNull() | F.col("_mn").isNull()).alias("_cold"))
    if on_unknown == "null":
        none = pairs.where(~whole).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("_ub", "_mb", "_uf", "_mf")],
                                          F.lit(False).alias("_known"), F.lit(True).alias("_cold"))
        out = out.unionByName(none)
    return out


def base_value(model: FactorModel):
    """Mean and biases; NULL where a key is unknown."""
    return F.when(F.col("_known"), F.lit(model.mean) + F.col("_ub") + F.col("_mb"))


def predict(model: FactorModel, pairs: DataFrame, uid_col: str = "uid", mid_col: str = "mid",
            out: str = "pred", on_unknown: str = "error", cold: str | None = None) -> DataFrame:
    """Score ``(uid key, mid key)`` rows; one output row per input row (``on_unknown`` as in
    ``keyed``).  ``cold`` names a column that tells the pairs with a key without training rows."""
    j = keyed(model, pairs, uid_col, mid_col, on_unknown)
    z = base_value(model) + F.lit(model.shrink) * F.coalesce(_dot(model.params["rank"]), F.lit(0.0))
    back = FT.inverse(j.withColumn("_z", z), "_z", model.quantiles, out)
    return back.select(*pairs.columns, shifted(F.col(out), model.offset, model.quantiles).alias(out),
                       *([F.col("_cold").alias(cold)] if cold else []))


def summary(pred: DataFrame, col: str = "pred", cold: str = "cold") -> DataFrame:
    """``(n_rows, n_null, n_cold)`` of predictions."""
    return pred.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(col).isNull()).alias("n_null"),
                    F.count_if(F.col(cold)).alias("n_cold"))


def save(model: FactorModel, path: str, run_log: str | None = None) -> str:
    """Directory of parts: user and item tables, quantile table, params.
    With ``run_log``, one row ``(path, trained_at, params)`` is appended to
    that table, so the newest artifact is a query (``latest``)."""
    spark = model.users.sparkSession
    model.users.write.mode("overwrite").parquet(f"{path}/users")
    model.items.write.mode("overwrite").parquet(f"{path}/items")
    model.quantiles.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiles")
    spark.createDataFrame([(json.dumps(model.params),)], "params string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/params")
    if run_log:
        (spark.createDataFrame([(path, json.dumps(model.params))], "path string, params string")
         .withColumn("trained_at", F.current_timestamp())
         .coalesce(1).write.mode("append").parquet(run_log))
    return path


def load(spark: SparkSession, path: str) -> FactorModel:
    q = spark.read.parquet(f"{path}/quantiles").orderBy("k").collect()  # <= 1,000 rows
    qm = FT.QuantileModel(tuple(r["reference"] for r in q), tuple(r["quantile"] for r in q))
    params = json.loads(spark.read.json(f"{path}/params").first()["params"])
    return FactorModel(spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"),
                       params["mean"], params["shrink"], qm, params, params.get("offset", 0.0))


def latest(paths_with_time: DataFrame) -> DataFrame:
    """Newest artifact of a run log ``(path, trained_at)``; of equal times the last path."""
    return paths_with_time.agg(F.max_by("path", F.struct("trained_at", "path")).alias("path"),
                               F.max("trained_at").alias("trained_at"))

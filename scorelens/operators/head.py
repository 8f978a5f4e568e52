"""Two-branch prediction head over user and item embeddings (M5, M6, M12, O2).

Forward, for embeddings ``e_u`` and ``e_m`` of width d (standardised with
population statistics of the training rows; batch norm at inference is an
affine map, so each one here is an element-wise affine with learned scale and
shift)::

    zu, zm = standardise(e_u), standardise(e_m)
    x      = [a_u*zu + c_u,  a_m*zm + c_m,  a_f*(zu*zm) + c_f]     (3d)
    out    = w2 . silu(W1 x + b1) + b2

Training is data-parallel local SGD: every epoch is one Spark job.  The current
parameters (a few hundred numbers) ship with the task; each partition is sorted
by a seeded hash and runs mini-batch Adam over it (rows that an Arrow batch
leaves over go into the next mini-batch, so only the partition's last one is
short); the driver averages the returned parameter vectors weighted by rows.
The result depends on the number of partitions, as local SGD does, and on
nothing else of the layout.  Loss is MSE on the normalised target, with Adam
weight decay, an exponential learning rate per epoch, a stop on divergence,
early stopping on the validation loss, and the best parameters kept: those of
an epoch or the average over all epochs.  The output is weighted by its
least-squares weight on the validation rows, from 0 to 1.  The embeddings stay in Spark tables (joined to the rows);
only the head's parameters reach the driver.

Scoring (``forward``) is an Arrow-batched pandas UDF: one numpy matrix
product per batch, parameters shipped with the function.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage


@dataclass(frozen=True)
class HeadConfig:
    dim: int = 6
    epochs: int = 25
    batch_size: int = 1024
    lr: float = 1e-2
    lr_gamma: float = 0.5
    weight_decay: float = 1e-3
    patience: int = 2
    min_delta: float = 1e-4
    divergence_factor: float | None = 10.0  # stop when a loss exceeds this many times the first
    seed: int = 373


@dataclass
class Head:
    dim: int
    mu_u: np.ndarray
    sd_u: np.ndarray
    mu_m: np.ndarray
    sd_m: np.ndarray
    params: np.ndarray
    log: list = field(default_factory=list)
    scale: float = 1.0
    offset: float = 0.0  # on the original scale: the mean of the training rows' errors

    def unpack(self):
        return unpack(self.params, self.dim)


def n_params(d: int) -> int:
    D = 3 * d
    return 6 * d + D * D + D + D + 1


def unpack(p: np.ndarray, d: int) -> dict:
    D = 3 * d
    out, i = {}, 0
    for name, size in (("a_u", d), ("c_u", d), ("a_m", d), ("c_m", d), ("a_f", d), ("c_f", d),
                       ("W1", D * D), ("b1", D), ("w2", D), ("b2", 1)):
        out[name] = p[i:i + size]
        i += size
    out["W1"] = out["W1"].reshape(D, D)
    return out


def init_params(d: int, seed: int, y_mean: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    D = 3 * d
    parts = [np.ones(d), np.zeros(d), np.ones(d), np.zeros(d), np.ones(d), np.zeros(d),
             rng.normal(0, 1 / np.sqrt(D), D * D), np.zeros(D), rng.normal(0, 0.01, D), [y_mean]]
    return np.concatenate([np.asarray(x, dtype=np.float64).ravel() for x in parts])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def forward_np(p: dict, zu: np.ndarray, zm: np.ndarray):
    x = np.concatenate([p["a_u"] * zu + p["c_u"], p["a_m"] * zm + p["c_m"],
                        p["a_f"] * (zu * zm) + p["c_f"]], axis=1)
    h = x @ p["W1"].T + p["b1"]
    sg = _sigmoid(h)
    s = h * sg
    out = s @ p["w2"] + p["b2"][0]
    return out, (x, h, sg, s)


def grad_np(p: dict, zu, zm, y):
    """Gradient of mean squared error with respect to every parameter."""
    out, (x, h, sg, s) = forward_np(p, zu, zm)
    n = len(y)
    dout = 2.0 * (out - y) / n
    g = {"w2": s.T @ dout, "b2": np.array([dout.sum()])}
    ds = np.outer(dout, p["w2"])
    dh = ds * (sg * (1.0 + h * (1.0 - sg)))
    g["W1"] = dh.T @ x
    g["b1"] = dh.sum(axis=0)
    dx = dh @ p["W1"]
    d = zu.shape[1]
    dxu, dxm, dxf = dx[:, :d], dx[:, d:2 * d], dx[:, 2 * d:]
    g["a_u"], g["c_u"] = (dxu * zu).sum(0), dxu.sum(0)
    g["a_m"], g["c_m"] = (dxm * zm).sum(0), dxm.sum(0)
    g["a_f"], g["c_f"] = (dxf * zu * zm).sum(0), dxf.sum(0)
    flat = np.concatenate([g[k].ravel() for k in ("a_u", "c_u", "a_m", "c_m", "a_f", "c_f",
                                                  "W1", "b1", "w2", "b2")])
    return flat, float(((out - y) ** 2).mean())


def _standardise(e: Column, mu, sd) -> list[Column]:
    return [(e[i].cast("double") - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i in range(len(mu))]


def features(rows: DataFrame, head: Head, eu: str = "eu", em: str = "em") -> DataFrame:
    zu = _standardise(F.col(eu), head.mu_u, head.sd_u)
    zm = _standardise(F.col(em), head.mu_m, head.sd_m)
    return rows.withColumn("zu", F.array(*zu)).withColumn("zm", F.array(*zm))


def forward(rows: DataFrame, head: Head, out: str = "z", eu: str = "eu", em: str = "em") -> DataFrame:
    """Head output per row: an Arrow-batched pandas UDF doing one numpy matrix
    product per batch (the 18 x 18 layer written as column literals makes
    Catalyst inline the arrays into every element access).  Rows without an
    embedding (a key unseen in training) get NULL."""
    p = head.unpack()
    mu_u, sd_u, mu_m, sd_m, scale = head.mu_u, head.sd_u, head.mu_m, head.sd_m, head.scale

    @F.pandas_udf("double")
    def _fwd(eu_s: pd.Series, em_s: pd.Series) -> pd.Series:
        ok = (eu_s.notna() & em_s.notna()).to_numpy()
        res = np.full(len(eu_s), np.nan)
        if ok.any():
            zu = (np.stack(eu_s[ok].to_numpy()).astype(np.float64) - mu_u) / sd_u
            zm = (np.stack(em_s[ok].to_numpy()).astype(np.float64) - mu_m) / sd_m
            res[ok] = scale * forward_np(p, zu, zm)[0]
        return pd.Series(res)

    z = _fwd(F.col(eu), F.col(em))
    return rows.withColumn(out, z).withColumn(out, F.when(F.isnan(out), None).otherwise(F.col(out)))


def _local_epoch(params: np.ndarray, d: int, cfg: HeadConfig, lr: float):
    """Partition function: mini-batch Adam over the partition's rows."""
    def run(batches):
        p = params.copy()
        m = np.zeros_like(p)
        v = np.zeros_like(p)
        t, n, sq = 0, 0, 0.0
        b1, b2, eps = 0.9, 0.999, 1e-8

        def minibatches():
            """Batches of exactly ``batch_size`` rows (the last one may be short)."""
            left = None
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                new = (np.stack(pdf["zu"].to_numpy()).astype(np.float64),
                       np.stack(pdf["zm"].to_numpy()).astype(np.float64), pdf["y"].to_numpy(dtype=np.float64))
                left = new if left is None else tuple(np.concatenate(x) for x in zip(left, new))
                k = cfg.batch_size
                while len(left[2]) >= k:
                    yield tuple(x[:k] for x in left)
                    left = tuple(x[k:] for x in left)
            if left is not None and len(left[2]):
                yield left

        for zu, zm, y in minibatches():
            g, loss = grad_np(unpack(p, d), zu, zm, y)
            g = g + cfg.weight_decay * p
            t += 1
            m = b1 * m + (1 - b1) * g
            v = b2 * v + (1 - b2) * g * g
            mh = m / (1 - b1 ** t)
            vh = v / (1 - b2 ** t)
            p = p - lr * mh / (np.sqrt(vh) + eps)
            n += len(y)
            sq += loss * len(y)
        if n:
            yield pd.DataFrame({"n": [n], "sq": [sq], "params": [p.tolist()]})

    return run


def train_head(rows: DataFrame, cfg: HeadConfig = HeadConfig(), train_part: str = "train",
               val_part: str = "val", quantiles=None) -> Head:
    """``rows``: ``(eu array, em array, y, part, uid, mid)`` and, for MAEs on the original
    scale, ``accuracy`` and ``_base`` (what ``y`` is measured from) plus the fitted
    ``quantiles`` (the losses are on the normalised scale)."""
    d = cfg.dim
    with_mae = quantiles is not None and "accuracy" in rows.columns
    # The joins that made the rows run once: the statistics and every epoch read them again.
    seen = stage(rows.where(F.col("part").isin(train_part, val_part)).select(
        "eu", "em", "y", "part", "uid", "mid", *(["accuracy", "_base"] if with_mae else [])), "head_rows")
    tr = seen.where(F.col("part") == train_part)
    stats = tr.agg(*[F.avg(F.col("eu")[i].cast("double")).alias(f"mu_u{i}") for i in range(d)],
                   *[F.stddev_pop(F.col("eu")[i].cast("double")).alias(f"sd_u{i}") for i in range(d)],
                   *[F.avg(F.col("em")[i].cast("double")).alias(f"mu_m{i}") for i in range(d)],
                   *[F.stddev_pop(F.col("em")[i].cast("double")).alias(f"sd_m{i}") for i in range(d)],
                   F.avg("y").alias("y_mean")).first()

    def vec(prefix):
        return np.array([stats[f"{prefix}{i}"] or 0.0 for i in range(d)], dtype=np.float64)

    sd_u, sd_m = vec("sd_u"), vec("sd_m")
    sd_u[sd_u == 0] = 1.0
    sd_m[sd_m == 0] = 1.0
    head = Head(d, vec("mu_u"), sd_u, vec("mu_m"), sd_m,
                init_params(d, cfg.seed, float(stats["y_mean"] or 0.0)))
    # Every epoch reads the same standardised rows: write them once.
    feats = stage(features(tr, head).select("zu", "zm", "y", "uid", "mid"), "head_train")

    def measured() -> dict:
        """Losses and MAEs of both parts, and the sums for the output's weight: one job."""
        z = forward(seen, head)
        own = [F.avg((F.col("z") - F.col("y")) ** 2).alias("loss"), F.sum(F.col("z") * F.col("y")).alias("zy"),
               F.sum(F.col("z") * F.col("z")).alias("zz")]
        if with_mae:
            from .features import inverse
            z = inverse(z.withColumn("_all", F.col("z") + F.col("_base")), "_all", quantiles, "_pred")
            own += [F.avg(F.abs(F.col("_pred") - F.col("accuracy"))).alias("mae"),
                    F.avg(F.col("accuracy").cast("double") - F.col("_pred")).alias("off")]
        return {r["part"]: r for r in z.groupBy("part").agg(*own).collect()}

    best, best_loss, first_loss, bad, lr, total = head.params, None, None, 0, cfg.lr, np.zeros_like(head.params)
    schema = "n long, sq double, params array<double>"
    for epoch in range(cfg.epochs):
        ordered = (feats.withColumn("_o", F.xxhash64(F.lit(cfg.seed), F.lit(epoch), "uid", "mid"))
                   .sortWithinPartitions("_o", "uid", "mid"))
        parts = ordered.mapInPandas(_local_epoch(head.params, d, cfg, lr), schema)
        # Row-weighted average of the partitions' parameters, summed on the
        # executors: one row per parameter reaches the driver, whatever the
        # partition count.
        avg = (parts.select("n", "sq", F.posexplode("params").alias("i", "v"))
               .groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"),
                                 F.sum("n").alias("n"), F.sum("sq").alias("sq"))
               .orderBy("i").collect())
        if not avg:
            break  # no training rows: the initial parameters stay
        head.params = np.array([r["v"] for r in avg], dtype=np.float64)
        total += head.params
        m = measured()
        loss = m[val_part]["loss"] if val_part in m else m[train_part]["loss"]
        head.log.append((epoch, lr, float(m[train_part]["loss"]), float(loss),
                         *[float(m[p]["mae"]) if with_mae and p in m else None for p in (train_part, val_part)]))
        first_loss = first_loss if first_loss is not None else loss
        if best_loss is None or loss < best_loss - cfg.min_delta:
            best, best_loss, bad = head.params.copy(), loss, 0
        else:
            bad += 1
        if cfg.divergence_factor is not None and not loss <= cfg.divergence_factor * max(first_loss, 1e-12):
            break
        if bad >= cfg.patience:
            break
        lr *= cfg.lr_gamma
    if head.log:
        head.params = total / len(head.log)
        m = measured()
        if not m.get(val_part, m[train_part])["loss"] < best_loss:
            head.params = best
            m = measured()
        w = m.get(val_part, m[train_part])
        head.scale = min(max(w["zy"] / w["zz"], 0.0), 1.0) if w["zz"] else 0.0
        if with_mae:
            head.offset = float(measured()[train_part]["off"] or 0.0)
    return head


def save_head(spark, head: Head, path: str) -> str:
    """The head as one JSON row."""
    own = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in head.__dict__.items()}
    spark.createDataFrame([(json.dumps(own),)], "head string").coalesce(1).write.mode("overwrite").json(path)
    return path


def load_head(spark, path: str) -> Head:
    own = json.loads(spark.read.json(path).first()["head"])
    return Head(**{k: np.array(v) if k.startswith(("mu", "sd", "params")) else v for k, v in own.items()})


def epoch_log(spark, head: Head) -> DataFrame:
    return spark.createDataFrame(
        head.log, "epoch int, lr double, train_loss double, val_loss double, "
        "train_mae double, val_mae double")


def best_epoch(log: DataFrame) -> DataFrame:
    """The epoch with the lowest validation loss; of equal ones the first."""
    return log.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("epoch"), F.min("val_loss").alias("val_loss"))

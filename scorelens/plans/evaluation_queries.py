"""Registered queries: evaluation aggregates, vector operators, embeddings,
model fit / predict / save (SURVEY §2.2 P15-P17, §2.5 A7-A11b, §2.9, C4, C6).

Aggregates that only need a ``(truth, prediction)`` frame use a deterministic
stand-in prediction, the item's mean accuracy, so DuckDB can check them
exactly; the model-backed keys get the rows-only check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TrainConfig
from ..functions import affine, fixed, hadamard, silu, vector_concat
from ..functions.numeric import dlit, fixed_sql
from ..operators import evaluate as EV
from ..operators import head as HD
from ..operators import model as MD
from ..session import shared_path
from ..sources.sinks import stage
from ..sources.tables import read_table
from .curation import curated_name
from .curation_queries import CFG
from .curation_queries import export as curated_export
from .curation_sql import with_curation
from .feature_queries import codes_ctes, split_ctes
from .modeling import (Trained, evaluation_report, head_predictions, holdout_predictions, predict_head,
                       train, train_two_branch)
from .registry import register

EV_CTE = """,
item_mean AS (SELECT mid, avg(CAST(accuracy AS DOUBLE)) AS pred FROM export GROUP BY mid),
ev AS (SELECT e.mid, e.uid, CAST(e.accuracy AS DOUBLE) AS y, m.pred
       FROM export e JOIN item_mean m ON e.mid = m.mid)"""


def eval_frame(spark, sf_dir):
    e = curated_export(spark, sf_dir)
    means = e.groupBy("mid").agg(F.avg(F.col("accuracy").cast("double")).alias("pred"))
    return e.join(means, "mid").select("mid", "uid", F.col("accuracy").cast("double").alias("y"),
                                       "pred")


def rounded(df, *cols):
    """The named columns as the oracle rounds them; the operators return raw doubles."""
    return df.withColumns({c: fixed(F.col(c)) for c in cols})


METRICS = ("mae", "rmse", "r2", "r2_swapped")


def _ev(select: str) -> str:
    return with_curation(EV_CTE + "\n" + select)


def _hist_sql(src: str, n: int, part_col: str = "series") -> str:
    """SQL mirror of ``evaluate.histogram`` over ``src(series, x)``."""
    nf = dlit(float(n))

    def edge(i):
        return f"(CASE WHEN {i} >= {n} THEN last ELSE {i} * step + first END)"

    return f""",
hs AS (SELECT {part_col}, min(x) AS mn, max(x) AS mx FROM {src} GROUP BY {part_col}),
hp AS (SELECT {part_col}, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS first,
              CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS last FROM hs),
hq AS (SELECT {part_col}, first, last, (last - first) / {nf} AS step FROM hp),
h0 AS (SELECT s.{part_col}, s.x, q.first, q.last, q.step,
              CAST(least(floor((s.x - q.first) / (q.last - q.first) * {nf}), {n - 1}) AS INTEGER) AS i0
       FROM {src} s JOIN hq q ON s.{part_col} = q.{part_col}),
h1 AS (SELECT *, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM h0),
h2 AS (SELECT {part_col}, CASE WHEN x >= {edge('(i1 + 1)')} AND i1 <> {n - 1} THEN i1 + 1 ELSE i1 END AS bin
       FROM h1),
hc AS (SELECT {part_col}, bin, count(*) AS c FROM h2 GROUP BY {part_col}, bin),
hb AS (SELECT q.{part_col}, CAST(r.bin AS INTEGER) AS bin, q.first, q.last, q.step
       FROM hq q CROSS JOIN range({n}) r(bin))"""


def _hist_select(part_col: str = "series", n: int = 25, keep_part: bool = True) -> str:
    lo = fixed_sql("b.bin * b.step + b.first")
    hi = fixed_sql(f"CASE WHEN b.bin + 1 >= {n} THEN b.last ELSE (b.bin + 1) * b.step + b.first END")
    part = f"b.{part_col}, " if keep_part else ""
    return (f"SELECT {part}b.bin, {lo} AS lo, {hi} AS hi, CAST(coalesce(c.c, 0) AS BIGINT) AS count "
            f"FROM hb b LEFT JOIN hc c ON b.{part_col} = c.{part_col} AND b.bin = c.bin")


# ---------------------------------------------------------------- metrics
_ERR = "(pred - y)"


@register("regression_metrics", _ev(
    f"SELECT count(*) AS n, {fixed_sql(f'avg(abs({_ERR}))')} AS mae, "
    f"{fixed_sql(f'sqrt(avg({_ERR} * {_ERR}))')} AS rmse, "
    f"{fixed_sql(f'1.0 - sum({_ERR} * {_ERR}) / (var_pop(y) * count(*))')} AS r2, "
    f"{fixed_sql(f'1.0 - sum({_ERR} * {_ERR}) / (var_pop(pred) * count(*))')} AS r2_swapped FROM ev"))
def q_regression_metrics(spark, sf_dir):
    return rounded(EV.regression_metrics(eval_frame(spark, sf_dir), "y", "pred"), *METRICS)


_BINS = EV.error_bins()
_BINS_SQL = ", ".join(f"({i}, {dlit(lo)}, {dlit(hi)}, '{lab}')" for i, lo, hi, lab in _BINS)


@register("error_by_bin", _ev(f""",
bins AS (SELECT CAST(bin AS INTEGER) AS bin, lo, hi, bound FROM (VALUES {_BINS_SQL}) t(bin, lo, hi, bound)),
agg AS (SELECT b.bin, count(*) AS n, avg(abs({_ERR})) AS mae, avg({_ERR} * {_ERR}) AS mse
        FROM ev JOIN bins b ON ev.y >= b.lo AND ev.y < b.hi GROUP BY b.bin)
SELECT b.bin, b.lo, b.hi, b.bound, coalesce(a.n, 0) AS n, {fixed_sql('a.mae')} AS mae,
       {fixed_sql('sqrt(a.mse)')} AS rmse
FROM bins b LEFT JOIN agg a ON a.bin = b.bin"""))
def q_error_by_bin(spark, sf_dir):
    return rounded(EV.error_by_bin(eval_frame(spark, sf_dir), "y", "pred"), "mae", "rmse")


@register("histogram_25", _ev(
    ",\nhx AS (SELECT 'pred' AS series, pred AS x FROM ev UNION ALL SELECT 'truth' AS series, y AS x FROM ev)"
    + _hist_sql("hx", 25) + "\n" + _hist_select("series", 25)))
def q_histogram_25(spark, sf_dir):
    both = eval_frame(spark, sf_dir).select(F.explode(F.array(
        F.struct(F.lit("pred").alias("series"), F.col("pred").alias("x")),
        F.struct(F.lit("truth").alias("series"), F.col("y").alias("x")))).alias("s")).select("s.*")
    return rounded(EV.histograms(both, ["pred", "truth"], 25), "lo", "hi")


@register("histogram_100", "WITH hx AS (SELECT 'dim1' AS series, CAST(embedding[2] AS DOUBLE) AS x "
          "FROM embeddings WHERE embedding[2] IS NOT NULL)"
          + _hist_sql("hx", 100) + "\n" + _hist_select("series", 100, keep_part=False))
def q_histogram_100(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("embedding")[1].alias("x"))
    return rounded(EV.histogram(emb, "x", 100), "lo", "hi")


@register("histogram_2d", _ev(
    ",\nd AS (SELECT y AS x, abs(pred - y) AS e FROM ev),"
    "\nb AS (SELECT min(x) AS mnx, max(x) AS mxx, min(e) AS mne, max(e) AS mxe FROM d)"
    """,
p AS (SELECT CASE WHEN mxx = mnx THEN mnx - 0.5 ELSE mnx END AS fx,
             CASE WHEN mxx = mnx THEN mxx + 0.5 ELSE mxx END AS lx,
             CASE WHEN mxe = mne THEN mne - 0.5 ELSE mne END AS fe,
             CASE WHEN mxe = mne THEN mxe + 0.5 ELSE mxe END AS le FROM b),
q AS (SELECT fx, lx, (lx - fx) / 25.0 AS sx, fe, le, (le - fe) / 25.0 AS se FROM p),
i0 AS (SELECT d.x, d.e, q.*,
              CAST(least(floor((d.x - fx) / (lx - fx) * 25.0), 24) AS INTEGER) AS ix0,
              CAST(least(floor((d.e - fe) / (le - fe) * 25.0), 24) AS INTEGER) AS ie0 FROM d, q),
i1 AS (SELECT *,
         CASE WHEN x < (CASE WHEN ix0 >= 25 THEN lx ELSE ix0 * sx + fx END) THEN ix0 - 1 ELSE ix0 END AS ix1,
         CASE WHEN e < (CASE WHEN ie0 >= 25 THEN le ELSE ie0 * se + fe END) THEN ie0 - 1 ELSE ie0 END AS ie1
       FROM i0),
i2 AS (SELECT
         CASE WHEN x >= (CASE WHEN ix1 + 1 >= 25 THEN lx ELSE (ix1 + 1) * sx + fx END) AND ix1 <> 24
              THEN ix1 + 1 ELSE ix1 END AS bin_x,
         CASE WHEN e >= (CASE WHEN ie1 + 1 >= 25 THEN le ELSE (ie1 + 1) * se + fe END) AND ie1 <> 24
              THEN ie1 + 1 ELSE ie1 END AS bin_y
       FROM i1)
SELECT bin_x, bin_y, count(*) AS count FROM i2 GROUP BY bin_x, bin_y"""))
def q_histogram_2d(spark, sf_dir):
    ev = eval_frame(spark, sf_dir).withColumn("err", F.abs(F.col("pred") - F.col("y")))
    return EV.histogram_2d(ev, "y", "err", 25)


PLOT_ROWS = 10_000


@register("plot_sample", _ev(f"SELECT mid, uid, y, {fixed_sql('pred')} AS pred FROM ev "
                             f"ORDER BY md5(concat_ws('|', '7', uid, mid)), uid, mid LIMIT {PLOT_ROWS}"))
def q_plot_sample(spark, sf_dir, n: int = PLOT_ROWS):
    """The ``n`` rows kept for plots, a reproducible hash order (a top-k by
    design: the metrics above use every row)."""
    ev = eval_frame(spark, sf_dir)
    return rounded(ev.orderBy(F.md5(F.concat_ws("|", F.lit("7"), "uid", "mid")), "uid", "mid").limit(n), "pred")


# ---------------------------------------------------------------- vectors / embeddings
def _halves(col):
    """The two halves of a vector, the second one longer by one if the width is odd."""
    n = F.size(col)
    half = F.floor(n / 2).cast("int")
    return F.slice(col, F.lit(1), half), F.slice(col, half + 1, n - half)


@register("vector_concat", "SELECT vec_id, list_concat(embedding[1:len(embedding) // 2], embedding[len(embedding) // 2 + 1:len(embedding)]) AS v "
          "FROM embeddings")
def q_vector_concat(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", vector_concat(*_halves("embedding")).alias("v"))


@register("factor_product", "SELECT vec_id, list_transform(range(1, len(embedding) // 2 + 1), "
          "lambda i: embedding[i] * embedding[i + len(embedding) // 2]) "
          "AS prod, " + fixed_sql("list_reduce(list_transform(range(1, len(embedding) // 2 + 1), "
                                  "lambda i: CAST(embedding[i] AS DOUBLE) "
                                  "* CAST(embedding[i + len(embedding) // 2] AS DOUBLE)), lambda a, b: a + b)")
          + " AS dot FROM embeddings")
def q_factor_product(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    u, m = _halves("embedding")
    dd = F.aggregate(F.zip_with(u, m, lambda a, b: a.cast("double") * b.cast("double")),
                     F.lit(0.0), lambda acc, x: acc + x)
    return e.select("vec_id", hadamard(u, m).alias("prod"), fixed(dd).alias("dot"))


@register("silu_vector", "SELECT vec_id, list_transform(embedding, lambda x: "
          + fixed_sql("CAST(x AS DOUBLE) / (1.0 + exp(-CAST(x AS DOUBLE)))") + ") AS act FROM embeddings")
def q_silu_vector(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    act = F.transform(silu(F.transform("embedding", lambda x: x.cast("double"))), lambda x: fixed(x))
    return e.select("vec_id", act.alias("act"))


# A fixed small layer for the affine query: two outputs over the first four elements.
AFFINE_W = [[1.0, 0.5, -0.25, 2.0], [0.0, 1.0, 0.0, -1.0]]
AFFINE_B = [0.1, -0.2]
_AFFINE_SQL = ", ".join(fixed_sql(" + ".join([dlit(b)] + [f"{dlit(w)} * CAST(embedding[{j + 1}] AS DOUBLE)" for j, w in enumerate(row)]))
                        for row, b in zip(AFFINE_W, AFFINE_B))


@register("affine_vector", f"SELECT vec_id, [{_AFFINE_SQL}] AS v FROM embeddings")
def q_affine_vector(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    v = affine(F.transform("embedding", lambda x: x.cast("double")), AFFINE_W, AFFINE_B)
    return e.select("vec_id", F.transform(v, lambda x: fixed(x)).alias("v"))


@register("minmax_dims", """WITH l AS (
  SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT dim, min(v) AS mn, max(v) AS mx FROM l GROUP BY dim)
SELECT l.vec_id, l.dim, """ + fixed_sql("CASE WHEN s.mx - s.mn = 0 THEN 0.0 ELSE (l.v - s.mn) / (s.mx - s.mn) END")
          + " AS value FROM l JOIN s ON l.dim = s.dim")
def q_minmax_dims(spark, sf_dir):
    return rounded(EV.minmax_long(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "value")


@register("embedding_join", "SELECT e.vec_id, e.label, c.c_name, c.c_mktsegment FROM embeddings e "
          "JOIN customer c ON e.vec_id = c.c_custkey")
def q_embedding_join(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vec_id"),
                                                      "c_name", "c_mktsegment")
    return e.join(c, "vec_id")


@register("embedding_pca")
def q_embedding_pca(spark, sf_dir):
    """Explained-variance ratio of 6 components of the 64-d embeddings."""
    _, explained = EV.pca(read_table(spark, sf_dir, "embeddings"), "embedding", 6, "vec_id")
    return explained


# ---------------------------------------------------------------- model-backed
_TRAIN_CFG = TrainConfig()
_FITTED: dict = {}


def _once(kind, spark, sf_dir, build):
    """One fit per application and curated dataset (its name follows the inputs' content);
    a fit of other inputs replaces it."""
    key = (spark.sparkContext.applicationId, curated_name(spark, sf_dir, CFG))
    if _FITTED.get(kind, (None,))[0] != key:
        _FITTED[kind] = (key, build())
    return _FITTED[kind][1]


def _trained(spark, sf_dir):
    return _once("als", spark, sf_dir, lambda: train(curated_export(spark, sf_dir), _TRAIN_CFG))


def _split_sql(select: str) -> str:
    return with_curation(split_ctes() + codes_ctes() + "\n" + select)


def _summary_sql(part: str) -> str:
    """Rows of a part, none without a prediction, and those with a key that no training row has."""
    return _split_sql(
        "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, "
        "count(*) FILTER (uid NOT IN (SELECT uid FROM split WHERE part = 'train') "
        f"OR mid NOT IN (SELECT mid FROM split WHERE part = 'train')) AS n_cold FROM split WHERE part = '{part}'")


@register("factor_model")
def q_factor_model(spark, sf_dir):
    """Factors and biases of both sides with their keys: ``(side, label, code, bias, n, emb)``."""
    m = _trained(spark, sf_dir).model
    return m.users.select(F.lit("user").alias("side"), "*").unionByName(m.items.select(F.lit("item").alias("side"), "*"))


@register("factor_lookup", _split_sql(
    "SELECT e.uid, e.mid, u.code AS uid_code, m.code AS mid_code, "
    "(SELECT count(*) FROM split t WHERE t.part = 'train' AND t.uid = e.uid) AS uid_rows, "
    "(SELECT count(*) FROM split t WHERE t.part = 'train' AND t.mid = e.mid) AS mid_rows "
    "FROM split e JOIN uid_codes u ON u.label = e.uid JOIN mid_codes m ON m.label = e.mid WHERE e.part = 'val'"))
def q_factor_lookup(spark, sf_dir):
    """J8: the validation pairs' codes and training rows, from the tables that hold their factors."""
    tr = _trained(spark, sf_dir)
    rows = tr.table.rows.where(F.col("part") == "val").select("uid", "mid")
    for x, t in (("uid", tr.model.users), ("mid", tr.model.items)):
        rows = rows.join(t.select(F.col("label").alias(x), F.col("code").alias(f"{x}_code"),
                                  F.coalesce("n", F.lit(0)).cast("bigint").alias(f"{x}_rows")), x)
    return rows


@register("holdout_predictions")
def q_holdout_predictions(spark, sf_dir):
    return holdout_predictions(_trained(spark, sf_dir), "val")


@register("holdout_summary", _summary_sql("val"))
def q_holdout_summary(spark, sf_dir):
    return MD.summary(holdout_predictions(_trained(spark, sf_dir), "val", cold="cold"))


def _pairs(spark, sf_dir):
    return _trained(spark, sf_dir).table.rows.where(F.col("part") == "test").select("uid", "mid")


@register("predict_pairs")
def q_predict_pairs(spark, sf_dir):
    """Every test-part pair scored in one plan (keys known by construction)."""
    return MD.predict(_trained(spark, sf_dir).model, _pairs(spark, sf_dir), on_unknown="error")


@register("predict_summary", _summary_sql("test"))
def q_predict_summary(spark, sf_dir):
    return MD.summary(MD.predict(_trained(spark, sf_dir).model, _pairs(spark, sf_dir), cold="cold"))


@register("head_predict_summary", _summary_sql("test"))
def q_head_predict_summary(spark, sf_dir):
    return MD.summary(predict_head(_trained(spark, sf_dir), _head(spark, sf_dir), _pairs(spark, sf_dir), cold="cold"))


@register("evaluation_report")
def q_evaluation_report(spark, sf_dir):
    return evaluation_report(holdout_predictions(_trained(spark, sf_dir), "val"))


@register("model_roundtrip", _split_sql(
    "SELECT count(DISTINCT (uid, mid)) AS n_pairs, 0.0::DOUBLE AS max_diff, 0.0::DOUBLE AS max_head_diff "
    "FROM split WHERE part = 'val'"))
def q_model_roundtrip(spark, sf_dir):
    """Save, load, score the val part with both, factor model and head; no difference."""
    tr, head = _trained(spark, sf_dir), _head(spark, sf_dir)
    path = shared_path(spark, "models", "roundtrip")
    MD.save(tr.model, path)
    HD.save_head(spark, head, f"{path}/head")
    again = Trained(tr.table, MD.load(spark, path))
    head2 = HD.load_head(spark, f"{path}/head")
    # Every check for unknown keys reads the pairs again: they are made once.
    rows = stage(tr.table.rows.where(F.col("part") == "val").select("uid", "mid").distinct(), "roundtrip_pairs")
    out = None
    for i, (t, h) in enumerate(((tr, head), (again, head2))):
        p = predict_head(t, h, stage(MD.predict(t.model, rows, out=f"p{i}"), "roundtrip_scored"), out=f"h{i}")
        out = p if out is None else out.join(p, ["uid", "mid"])
    return out.agg(F.count(F.lit(1)).alias("n_pairs"), F.max(F.abs(F.col("p0") - F.col("p1"))).alias("max_diff"),
                   F.max(F.abs(F.col("h0") - F.col("h1"))).alias("max_head_diff"))


@register("embedding_report")
def q_embedding_report(spark, sf_dir):
    """Factors of both sides -> PCA (6) -> min-max, with the explained variance of each
    component, decoded to (id, year or speed) and joined to the items' or users' names."""
    tr = _trained(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                                                    (F.col("p_size") / 4.0).alias("difficultyrating"))
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                         F.lit(None).cast("double").alias("difficultyrating"))
    out = None
    for side, table, names in (("item", tr.model.items, part), ("user", tr.model.users, users)):
        proj, explained = EV.pca(table.where(F.col("emb").isNotNull()).select("label", "emb"), "emb", 6, "label")
        ratio = explained.agg(F.transform(F.sort_array(F.collect_list(F.struct("component", "explained"))),
                                          lambda x: x["explained"])).scalar()  # one value per component
        dec = proj.select(F.lit(side).alias("side"), F.split_part("label", F.lit("/"), F.lit(1)).cast("bigint").alias("id"),
                          F.split_part("label", F.lit("/"), F.lit(2)).alias("variant"), "pc", ratio.alias("explained"))
        one = dec.join(names, "id", "left")
        out = one if out is None else out.unionByName(one)
    return out


def _head(spark, sf_dir):
    return _once("head", spark, sf_dir, lambda: train_two_branch(_trained(spark, sf_dir)))


@register("als_metrics")
def q_als_metrics(spark, sf_dir):
    """A7/A8 on the ALS model's validation predictions, cold-start rows included."""
    return EV.regression_metrics(holdout_predictions(_trained(spark, sf_dir), "val"), "y", "pred")


@register("epoch_log")
def q_epoch_log(spark, sf_dir):
    """M12: one row per data-parallel epoch of the two-branch head."""
    return HD.epoch_log(spark, _head(spark, sf_dir))


@register("best_epoch", "SELECT epoch, val_loss FROM (SELECT CAST(l_linenumber AS INTEGER) AS epoch, "
          f"{fixed_sql('avg(l_discount)')} AS val_loss FROM lineitem GROUP BY l_linenumber) "
          "ORDER BY val_loss, epoch LIMIT 1")
def q_best_epoch(spark, sf_dir):
    """O2 on a log that is made of a table, so that SQL can check it: the epoch with the
    lowest validation loss (``epoch_log`` has the head's own log)."""
    log = (read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("epoch"))
           .agg(fixed(F.avg("l_discount")).alias("val_loss")))
    return HD.best_epoch(log)


@register("forward_scores")
def q_forward_scores(spark, sf_dir):
    """M5: validation pairs scored by the two-branch head (a pandas UDF: one matrix product per Arrow batch)."""
    return head_predictions(_trained(spark, sf_dir), _head(spark, sf_dir), "val")


@register("head_metrics")
def q_head_metrics(spark, sf_dir):
    """A7/A8 on the two-branch head's validation predictions."""
    pred = head_predictions(_trained(spark, sf_dir), _head(spark, sf_dir), "val")
    return EV.regression_metrics(pred, "y", "pred")


@register("latest_run", "SELECT 'run_' || o_orderkey AS path, CAST(o_orderdate AS TIMESTAMP) AS trained_at FROM orders "
          "ORDER BY o_orderdate DESC, 'run_' || o_orderkey DESC LIMIT 1")
def q_latest_run(spark, sf_dir):
    """S15/O3 on a run log that is made of a table, so that SQL can check it."""
    log = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("trained_at"))
    return MD.latest(log)


@register("head_predict_pairs")
def q_head_predict_pairs(spark, sf_dir):
    """M7 with the network: every test-part pair scored by the two-branch head."""
    tr = _trained(spark, sf_dir)
    pairs = tr.table.rows.where(F.col("part") == "test").select("uid", "mid")
    return predict_head(tr, _head(spark, sf_dir), pairs, on_unknown="error")

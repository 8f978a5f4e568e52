"""Evaluation aggregates over any ``(truth, prediction)`` frame.

All of them are single-pass aggregates (partial aggregation map-side, one
small shuffle); bin tables are built from parameters, so their size is fixed
and broadcasting them is safe.  Bin edges follow evenly spaced edges
``start + i * (stop - start) / n`` with the last edge exact, and a value
belongs to the bin whose edges hold it (``lo <= x < hi``; for histograms the
last bin also holds the maximum).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The error-by-accuracy report covers [0.70, 1.00) in 30 bins.
ERROR_BIN_START = 0.7
ERROR_BIN_STOP = 1.0
ERROR_BIN_COUNT = 30


def linspace(start: float, stop: float, num: int) -> list[float]:
    step = (stop - start) / (num - 1)
    out = [i * step + start for i in range(num)]
    out[-1] = stop
    return out


def percent_label(x: float) -> str:
    return f"{x:.0%}"


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE, R2 and the reference's R2 with the arguments swapped
    (prediction as the truth), unrounded; a NaN makes the figures NaN, NULL
    errors count in ``n`` only, no rows give NULL figures."""
    err = F.col(pred) - F.col(y)
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.avg(F.abs(err)).alias("mae"),
               F.avg(err * err).alias("mse"),
               F.sum(err * err).alias("sse"),
               F.var_pop(y).alias("var_y"),
               F.var_pop(pred).alias("var_p"))
    return a.select("n", "mae", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("var_y") * F.col("n"))).alias("r2"),
                    (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("var_p") * F.col("n"))).alias("r2_swapped"))


def error_bins(start=ERROR_BIN_START, stop=ERROR_BIN_STOP, n=ERROR_BIN_COUNT) -> list[tuple]:
    e = linspace(start, stop, n + 1)
    return [(i, e[i], e[i + 1], percent_label(e[i + 1])) for i in range(n)]


def error_by_bin(df: DataFrame, y: str = "y", pred: str = "pred", start=ERROR_BIN_START,
                 stop=ERROR_BIN_STOP, n=ERROR_BIN_COUNT) -> DataFrame:
    """MAE / RMSE per truth bin; empty bins are kept with NULL errors."""
    spark = df.sparkSession
    bins = error_bins(start, stop, n)
    splits = [float("-inf")] + [b[1] for b in bins] + [bins[-1][2], float("inf")]
    src = df.select(F.col(y).cast("double").alias("_y"), F.col(pred).cast("double").alias("_p"))
    src = src.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    b = Bucketizer(splits=splits, inputCol="_y", outputCol="_b").transform(src)
    err = F.col("_p") - F.col("_y")
    agg = (b.where((F.col("_b") >= 1) & (F.col("_b") <= n))
           .groupBy((F.col("_b") - 1).cast("int").alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
                F.avg(err * err).alias("mse")))
    table = spark.createDataFrame(bins, "bin int, lo double, hi double, bound string")
    # agg has a row per bin at most: it is the side to broadcast in this left join
    return (table.join(F.broadcast(agg), "bin", "left")
            .select("bin", "lo", "hi", "bound", F.coalesce("n", F.lit(0)).alias("n"), "mae",
                    F.sqrt("mse").alias("rmse")))


def _with_bins(df: DataFrame, x: str, lo, hi, n: int, out: str) -> DataFrame:
    """Add ``out`` = bin of ``x`` among n equal bins of [lo, hi] with edges
    lo + i*step (last edge hi), the maximum in the last bin; an empty range
    widens by 0.5 on each side.  Each step is its own projection so the bounds
    (scalar subqueries) are referenced once, not copied into nested expressions."""
    t = (df.withColumn("_lo", lo).withColumn("_hi", hi)
         .withColumn("_first", F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") - 0.5).otherwise(F.col("_lo")))
         .withColumn("_last", F.when(F.col("_hi") == F.col("_lo"), F.col("_hi") + 0.5).otherwise(F.col("_hi")))
         .withColumn("_step", (F.col("_last") - F.col("_first")) / F.lit(float(n))))

    def edge(i):
        return F.when(i >= n, F.col("_last")).otherwise(i * F.col("_step") + F.col("_first"))

    xc = F.col(x)
    t = t.withColumn("_i0", F.least(F.floor((xc - F.col("_first")) / (F.col("_last") - F.col("_first"))
                                            * F.lit(float(n))), F.lit(n - 1)).cast("int"))
    t = t.withColumn("_i1", F.when(xc < edge(F.col("_i0")), F.col("_i0") - 1).otherwise(F.col("_i0")))
    t = t.withColumn(out, F.when((xc >= edge(F.col("_i1") + 1)) & (F.col("_i1") != n - 1),
                                 F.col("_i1") + 1).otherwise(F.col("_i1")))
    return t.drop("_lo", "_hi", "_i0", "_i1")


def histogram(df: DataFrame, col: str, n: int = 25, series: str | None = None) -> DataFrame:
    """``(bin, lo, hi, count)`` for n equal bins between the column's least and greatest
    finite value; every bin is present.  NaN and infinite values are counted in one more
    row, bin -1 with NULL edges, if there are any; NULLs are not values.  Without a finite
    value the edges are NULL and the counts 0."""
    out = histograms(df.select(F.lit(series or "").alias("series"), F.col(col).cast("double").alias("x")), [series or ""], n)
    return out if series is not None else out.drop("series")


def histograms(df: DataFrame, names: list[str], n: int = 25) -> DataFrame:
    """Histograms of the series ``names`` of ``(series, x)``, in one pass for the bounds and
    one for the counts: ``(series, bin, lo, hi, count)``, as ``histogram``."""
    spark = df.sparkSession
    x = df.select("series", F.col("x").cast("double").alias("_x")).where(F.col("_x").isNotNull())
    finite = ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    good = F.when(finite, F.col("_x"))
    # one scalar subquery with the bounds of all series: one pass, no join
    bounds = x.agg(F.struct(*[f(F.when(F.col("series") == s, good)).alias(f"{side}{k}") for k, s in enumerate(names)
                              for side, f in (("mn", F.min), ("mx", F.max))])).scalar()

    def bound(side):
        out = None
        for k, s in enumerate(names):
            v = bounds.getField(f"{side}{k}")
            out = F.when(F.col("series") == s, v) if out is None else out.when(F.col("series") == s, v)
        return out

    binned = _with_bins(x.where(finite), "_x", bound("mn"), bound("mx"), n, "bin").select("series", "bin")
    counts = binned.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("count"))
    table = (spark.createDataFrame([(s, i) for s in names for i in range(n)], "series string, bin int")
             .withColumn("mn", bound("mn")).withColumn("mx", bound("mx")))
    mn, mx, i = F.col("mn"), F.col("mx"), F.col("bin")
    table = (table.withColumn("_first", F.when(mx == mn, mn - 0.5).otherwise(mn))
             .withColumn("_last", F.when(mx == mn, mx + 0.5).otherwise(mx))
             .withColumn("_step", (F.col("_last") - F.col("_first")) / F.lit(float(n))))
    table = table.select("series", "bin", (i * F.col("_step") + F.col("_first")).alias("lo"),
                         F.when(i + 1 >= n, F.col("_last")).otherwise((i + 1) * F.col("_step") + F.col("_first")).alias("hi"))
    # counts has a row per bin at most: the side to broadcast
    out = (table.join(F.broadcast(counts), ["series", "bin"], "left")
           .select("series", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
    none = F.lit(None).cast("double")
    odd = (x.where(~finite).groupBy("series").agg(F.count(F.lit(1)).alias("count"))
           .select("series", F.lit(-1).alias("bin"), none.alias("lo"), none.alias("hi"), "count"))
    return out.unionByName(odd)


def histogram_2d(df: DataFrame, xcol: str, ycol: str, n: int = 25) -> DataFrame:
    """Non-empty cells of an n x n histogram: ``(bin_x, bin_y, count)``."""
    d = df.select(F.col(xcol).cast("double").alias("_x"), F.col(ycol).cast("double").alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    bnd = d.select(F.struct(F.min("_x").alias("lx"), F.max("_x").alias("hx"),
                            F.min("_y").alias("ly"), F.max("_y").alias("hy"))).scalar()
    mnx, mxx, mny, mxy = (bnd.getField(f) for f in ("lx", "hx", "ly", "hy"))
    t = _with_bins(d, "_x", mnx, mxx, n, "bin_x").drop("_first", "_last", "_step")
    t = _with_bins(t, "_y", mny, mxy, n, "bin_y")
    return t.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def minmax_scaled(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, scaled)``: each dimension of an array column scaled to [0, 1] by its least and
    greatest value; a constant dimension gives 0, NULL and NaN elements stay as they are."""
    v = df.select(id_col, F.transform(vec_col, lambda e: e.cast("double")).alias("_v"))
    real = F.when(~F.isnan("x"), F.col("x"))
    # a scalar subquery: one entry per dimension, bounded by the vector width
    stats = (v.select(F.posexplode("_v").alias("dim", "x")).groupBy("dim")
             .agg(F.min(real).alias("mn"), F.max(real).alias("mx"))
             .agg(F.sort_array(F.collect_list(F.struct("dim", "mn", "mx"))).alias("s"))).scalar()
    scaled = F.zip_with("_v", "_s", lambda x, s: F.when(x.isNull() | F.isnan(x), x).when(s["mx"] == s["mn"], F.lit(0.0)).otherwise(
        (x - s["mn"]) / (s["mx"] - s["mn"])))
    return v.withColumn("_s", stats).select(id_col, F.slice(scaled, F.lit(1), F.size("_v")).alias("scaled"))


def minmax_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``minmax_scaled`` in long format ``(id, dim, value)``."""
    return (minmax_scaled(df, id_col, vec_col)
            .select(id_col, F.posexplode("scaled").alias("dim", "value")))


def pca(df: DataFrame, vec_col: str, k: int = 6, id_col: str | None = None):
    """PCA (Spark ML; the covariance is a distributed d x d aggregate).

    Returns ``(projected, explained)``: projected rows carry ``pc`` (array of k
    components, each min-max scaled to [0, 1], which also removes the
    centring difference between libraries), and ``explained`` has the
    explained-variance ratio per component rounded to 3 places.  Component
    signs are made deterministic: the largest-magnitude loading is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = df.sparkSession
    v = df.withColumn("_v", array_to_vector(F.transform(vec_col, lambda e: e.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(v)
    pcs = model.pc.toArray()  # d x k, small (bounded by the vector width)
    signs = []
    for j in range(pcs.shape[1]):
        col = pcs[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    proj = model.transform(v).withColumn("_a", vector_to_array("_pc"))
    proj = proj.withColumn("_a", F.transform("_a", lambda e, i: e * F.element_at(
        F.array(*[F.lit(s) for s in signs]), i + 1)))
    keep = [id_col] if id_col else []
    comp = proj.select(*keep, *[F.col("_a")[j].alias(f"pc{j}") for j in range(k)])
    # one struct-valued scalar subquery: every component's min and max in one pass
    bnd = comp.select(F.struct(*[F.min(f"pc{j}").alias(f"mn{j}") for j in range(k)],
                               *[F.max(f"pc{j}").alias(f"mx{j}") for j in range(k)])).scalar()
    mins = [bnd.getField(f"mn{j}") for j in range(k)]
    maxs = [bnd.getField(f"mx{j}") for j in range(k)]
    cols = []
    for j in range(k):
        rng = maxs[j] - mins[j]
        cols.append(F.when(rng == 0, F.lit(0.0)).otherwise((F.col(f"pc{j}") - mins[j]) / rng))
    projected = comp.select(*keep, F.array(*cols).alias("pc"))
    ratios = model.explainedVariance.toArray()
    explained = spark.createDataFrame(
        [(j, float(round(r, 3))) for j, r in enumerate(ratios)], "component int, explained double")
    return projected, explained

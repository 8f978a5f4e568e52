"""Feature preparation: label codes, the quantile-to-normal target transform
and the exact seeded split.

Quantile transform semantics (as scikit-learn's ``QuantileTransformer`` with
``output_distribution='normal'``): ``n_quantiles = min(1000, n)`` evenly
spaced references in [0, 1]; the quantiles are linear-interpolated order
statistics of the whole column; a value maps to the average of the forward and
backward piecewise-linear interpolation (so a run of tied quantiles maps to
the middle of its references); values within 1e-7 of the ends map to 0 / 1;
then the normal quantile, clipped.  The inverse maps through the normal CDF and
a plain interpolation.  No subsampling: the fit uses every row.

How it runs: the fit builds a value histogram (``groupBy(value).count()``, which
combines map-side), numbers it with a distributed prefix sum, and keeps only the
histogram rows that hold one of the at most 2,000 needed order statistics; those
few rows reach the driver, which interpolates the <= 1,000 quantiles.  Applying
the transform uses ``Bucketizer`` (a JVM binary search over the quantile
knots) and an equi-join to the knot table, whose size is bounded by
``n_quantiles``, so broadcasting it is safe at any data size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import BOUNDS_THRESHOLD, CLIP_HIGH, CLIP_LOW, cdf, with_inv_cdf
from ..sources.sinks import stage
from .ranking import prefix_sum, row_index

MAX_QUANTILES = 1000


# ---------------------------------------------------------------- label codes
def label_codes(df: DataFrame, col: str, n_partitions: int | None = None) -> DataFrame:
    """``(label, code)``: codes 0..n-1 follow the sorted (byte) order of the
    distinct labels, as a sorted-classes label encoder.  Distributed: the
    distinct labels are range-partitioned and numbered by a prefix sum."""
    labels = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return row_index(labels, ["label"], "code", n_partitions)


def label_codes_many(df: DataFrame, cols: list[str], n_partitions: int | None = None) -> dict:
    """Code tables for several label columns from one ranking pass: the
    labels of all columns are ranked together by ``(column, label)`` and each
    column's codes start at 0 (its smallest rank is subtracted)."""
    parts = [df.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("label"))
             .where(F.col("label").isNotNull()) for c in cols]
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    ranked = row_index(labels.distinct(), ["kind", "label"], "idx", n_partitions)
    first = ranked.groupBy("kind").agg(F.min("idx").alias("_first"))  # one row per column
    coded = ranked.join(F.broadcast(first), "kind").select(
        "kind", "label", (F.col("idx") - F.col("_first")).alias("code"))
    return {c: coded.where(F.col("kind") == c).select("label", "code") for c in cols}


def encode(df: DataFrame, col: str, codes: DataFrame, out: str, how: str = "inner") -> DataFrame:
    """Add codes for labels (``inner``: rows with unknown labels drop; ``left``:
    they keep a NULL code; use ``unknown_labels`` first to raise instead)."""
    return df.join(codes.select(F.col("label").alias(col), F.col("code").alias(out)), col, how)


def decode(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    return df.join(codes.select(F.col("code").alias(col), F.col("label").alias(out)), col)


def unknown_labels(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    return (df.select(col).where(F.col(col).isNotNull())
            .join(codes.select(F.col("label").alias(col)), col, "left_anti").distinct())


def check_known(df: DataFrame, cols_codes: dict[str, DataFrame]) -> None:
    """Raise ValueError when any label is NULL or not in its code table (two small jobs per
    column; their counts and the five smallest unknown labels reach the driver)."""
    for col, codes in cols_codes.items():
        n_null = df.where(F.col(col).isNull()).count()
        if n_null:
            raise ValueError(f"{n_null} rows with a NULL {col}")
        bad = unknown_labels(df, col, codes)
        n = bad.count()
        if n:
            raise ValueError(f"{n} unknown {col} labels, among them {[r[0] for r in bad.orderBy(col).limit(5).collect()]}")


# ---------------------------------------------------------------- quantiles
@dataclass(frozen=True)
class QuantileModel:
    references: tuple
    quantiles: tuple

    @property
    def n(self) -> int:
        return len(self.references)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, float(r), float(q)) for i, (r, q) in enumerate(zip(self.references, self.quantiles))],
            "k int, reference double, quantile double")

    def knots(self) -> list[tuple]:
        """Distinct quantile values with the lowest and highest reference of
        their tie run: [(q, r_lo, r_hi), ...] in increasing q."""
        out: list[list] = []
        for r, q in zip(self.references, self.quantiles):
            if out and out[-1][0] == q:
                out[-1][2] = r
            else:
                out.append([q, r, r])
        return [tuple(k) for k in out]


def references(n_quantiles: int) -> list[float]:
    """Evenly spaced references in [0, 1], both ends exact (as linspace)."""
    if n_quantiles == 1:
        return [0.0]
    step = 1.0 / (n_quantiles - 1)
    refs = [k * step for k in range(n_quantiles)]
    refs[-1] = 1.0
    return refs


def fit_quantiles(df: DataFrame, col: str, n_quantiles: int = MAX_QUANTILES) -> QuantileModel:
    """Exact linear-interpolated quantiles at the references."""
    hist = (df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
            .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    cum = prefix_sum(hist, ["v"], "c", "end")  # ranks [end - c, end) hold value v
    n = cum.agg(F.max("end")).first()[0]
    if not n:
        raise ValueError(f"cannot fit quantiles of an empty column {col!r}")
    nq = min(n_quantiles, n)
    refs = references(nq)
    pos = [r * (n - 1) for r in refs]
    needed = sorted({int(math.floor(p)) for p in pos} | {min(int(math.floor(p)) + 1, n - 1) for p in pos})
    splits = [-math.inf] + [r + 0.5 for r in needed] + [math.inf]
    with_start = cum.withColumn("lo", F.col("end") - F.col("c") - 0.5).withColumn("hi", F.col("end") - 0.5)
    bz = Bucketizer(splitsArray=[splits, splits], inputCols=["lo", "hi"], outputCols=["b_lo", "b_hi"])
    hits = (bz.transform(with_start).where(F.col("b_lo") != F.col("b_hi"))
            .select("v", "c", "end").collect())
    ranges = sorted((int(r["end"]) - int(r["c"]), int(r["end"]), float(r["v"])) for r in hits)

    def at(rank: int) -> float:
        lo, hi = 0, len(ranges) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if ranges[mid][1] <= rank:
                lo = mid + 1
            else:
                hi = mid
        start, end, v = ranges[lo]
        assert start <= rank < end
        return v

    qs = []
    for p in pos:
        i = int(math.floor(p))
        frac = p - i
        a = at(i)
        b = at(min(i + 1, n - 1))
        qs.append(a + (b - a) * frac)
    # Quantiles must be non-decreasing (interpolation can break it by an ulp).
    for i in range(1, len(qs)):
        qs[i] = max(qs[i], qs[i - 1])
    return QuantileModel(tuple(refs), tuple(qs))


def _knot_frame(spark: SparkSession, model: QuantileModel) -> DataFrame:
    ks = model.knots()
    rows = []
    for j, (q, r_lo, r_hi) in enumerate(ks):
        nxt = ks[j + 1] if j + 1 < len(ks) else (None, None, None)
        rows.append((j + 1, q, r_lo, r_hi, nxt[0], nxt[1]))
    return spark.createDataFrame(
        rows, "b int, q double, r_lo double, r_hi double, q_next double, r_next double")


def to_uniform(df: DataFrame, col: str, model: QuantileModel, out: str) -> DataFrame:
    """Forward step without the normal quantile: value -> [0, 1]."""
    spark = df.sparkSession
    ks = model.knots()
    splits = [-math.inf] + [k[0] for k in ks] + [math.inf]
    x = F.col(col).cast("double")
    tmp = df.withColumn("_x", x).withColumn("_xb", F.coalesce(F.col("_x"), F.lit(0.0)))
    b = Bucketizer(splits=splits, inputCol="_xb", outputCol="_b").transform(tmp)
    knots = F.broadcast(_knot_frame(spark, model))  # <= n_quantiles rows
    j = b.withColumn("_b", F.col("_b").cast("int")).join(knots.withColumnRenamed("b", "_b"), "_b", "left")
    slope = (F.col("r_next") - F.col("r_hi")) / (F.col("q_next") - F.col("q"))
    fwd = slope * (F.col("_x") - F.col("q")) + F.col("r_hi")
    bwd = slope * (F.col("q_next") - F.col("_x")) - F.col("r_next")
    inner = F.when(F.col("_x") == F.col("q"), F.lit(0.5) * (F.col("r_lo") + F.col("r_hi"))) \
        .otherwise(F.lit(0.5) * (fwd - bwd))
    q_first, q_last = ks[0][0], ks[-1][0]
    u = (F.when(F.col("_x").isNull(), F.lit(None).cast("double"))
         .when(F.col("_x") - BOUNDS_THRESHOLD < q_first, F.lit(0.0))
         .when(F.col("_x") + BOUNDS_THRESHOLD > q_last, F.lit(1.0))
         .otherwise(inner))
    keep = [c for c in df.columns if c != out]
    return j.select(*keep, u.alias(out))


def normalize(df: DataFrame, col: str, model: QuantileModel, out: str | None = None) -> DataFrame:
    """Quantile-to-normal transform of ``col`` (replaced unless ``out``)."""
    out = out or col
    u = with_inv_cdf(to_uniform(df, col, model, "_u"), "_u", "_z")
    z = (F.when(F.col("_u").isNull(), F.lit(None).cast("double"))
         .when(F.col("_u") <= 0, F.lit(CLIP_LOW))
         .when(F.col("_u") >= 1, F.lit(CLIP_HIGH))
         .otherwise(F.least(F.greatest(F.col("_z"), F.lit(CLIP_LOW)), F.lit(CLIP_HIGH))))
    keep = [c for c in u.columns if c not in ("_u", "_z", out)]
    return u.select(*keep, z.alias(out))


def inverse(df: DataFrame, col: str, model: QuantileModel, out: str | None = None) -> DataFrame:
    """Normal score back to the original scale."""
    spark = df.sparkSession
    out = out or col
    refs, qs = model.references, model.quantiles
    p = cdf(F.col(col).cast("double"))
    tmp = df.withColumn("_p", p).withColumn("_pb", F.coalesce(F.col("_p"), F.lit(0.0)))
    splits = [-math.inf] + list(refs) + [math.inf]
    b = Bucketizer(splits=splits, inputCol="_pb", outputCol="_b").transform(tmp)
    rows = [(k + 1, refs[k], qs[k], refs[k + 1] if k + 1 < len(refs) else None,
             qs[k + 1] if k + 1 < len(qs) else None) for k in range(len(refs))]
    tab = F.broadcast(spark.createDataFrame(
        rows, "_b int, r double, q double, r_next double, q_next double"))
    j = b.withColumn("_b", F.col("_b").cast("int")).join(tab, "_b", "left")
    slope = (F.col("q_next") - F.col("q")) / (F.col("r_next") - F.col("r"))
    interp = F.when(F.col("r_next").isNull(), F.col("q")).otherwise(
        slope * (F.col("_p") - F.col("r")) + F.col("q"))
    y = (F.when(F.col("_p").isNull(), F.lit(None).cast("double"))
         .when(F.col("_p") - BOUNDS_THRESHOLD < 0, F.lit(float(qs[0])))
         .when(F.col("_p") + BOUNDS_THRESHOLD > 1, F.lit(float(qs[-1])))
         .otherwise(interp))
    keep = [c for c in df.columns if c != out]
    return j.select(*keep, y.alias(out))


# ---------------------------------------------------------------- split
PARTS = ("train", "test", "val")
HASH_BITS = 60   # of ``split_hash``
GROUP_BITS = 16  # of them, whose rows are counted together


def split_sizes(n: int, fractions=(0.8, 0.1, 0.1)) -> tuple[int, int, int]:
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("train/test/val fractions must sum to 1")
    n_train = int(n * fractions[0])
    n_test = int(n * fractions[1])
    return n_train, n_test, n - n_train - n_test


def split_hash(df: DataFrame, seed: int):
    """Seeded 60-bit hash of a row's text columns (all columns if it has none); md5, so that
    other engines can repeat it."""
    cols = [f.name for f in df.schema if f.dataType.simpleString() == "string"] or df.columns
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def exact_split(df: DataFrame, fractions=(0.8, 0.1, 0.1), seed: int = 373,
                n_partitions: int | None = None) -> DataFrame:
    """Add ``part`` in {train, test, val} with exact sizes int(.8n), int(.1n),
    rest.  Rows are ordered by ``split_hash`` and then by all their columns, so
    the split does not depend on partitioning or input order; identical rows
    are interchangeable.

    Only the rows near a cut are put in order: rows are counted by the first bits of
    their hash, a group of hashes that lies whole in one part gives its rows that part, and
    the (at most two) groups with a cut inside are ranked."""
    cols = df.columns
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("train/test/val fractions must sum to 1")
    h = df.withColumn("_h", split_hash(df, seed))
    g = F.shiftright("_h", HASH_BITS - GROUP_BITS)
    per = h.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** GROUP_BITS rows
    ends = stage(per.select("g", "n", F.sum("n").over(Window.orderBy("g")).alias("end")), "split_groups")
    n = ends.agg(F.max("end")).first()[0] or 0
    n_train = int(n * fractions[0])
    cuts = [n_train, n_train + int(n * fractions[1])]
    # ``(g, rows before g)`` of the group that holds the row at each cut.
    at = [ends.where(F.col("end") > c).agg(F.min("g").alias("g"), F.min_by(F.col("end") - F.col("n"), "g").alias("before")).first()
          for c in cuts]

    def part(first, second):
        return F.when(first, F.lit("train")).when(second, F.lit("test")).otherwise(F.lit("val"))

    whole, found = F.lit(True), {}
    for c, a in zip(cuts, at):
        if a["g"] is not None and a["before"] < c:  # a cut inside the group
            whole, found[a["g"]] = whole & (g != a["g"]), a["before"]
    # A cut at or after the last row has all groups before it.
    before = [F.lit(True) if a["g"] is None else g < a["g"] for a in at]
    out = h.where(whole).select(*cols, part(*before).alias("part"))
    for k, first in found.items():
        # Identical rows share a hash; the position tie-breaker lets the range partitioner split
        # a large group of copies.  Copies are interchangeable, so which copy lands in which
        # part does not change the result.
        i = row_index(h.where(g == k).withColumn("_t", F.monotonically_increasing_id()), ["_h", *cols, "_t"], "_i", n_partitions)
        pos = F.col("_i") + first
        out = out.unionByName(i.select(*cols, part(*[pos < c for c in cuts]).alias("part")))
    return out

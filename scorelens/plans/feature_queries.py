"""Registered queries: label codes, quantile transform, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TrainConfig
from ..functions import fixed
from ..functions.normal import (BOUNDS_THRESHOLD, CLIP_HIGH, CLIP_LOW, cdf_sql,
                                inv_cdf_sql)
from ..functions.numeric import dlit, fixed_sql
from ..operators import features as FT
from .curation_queries import export as curated_export
from .curation_sql import with_curation
from .registry import register
from .training import training_table

NQ = 1000  # the fixture's curated sets have more than 1,000 rows at every scale
REFS = FT.references(NQ)
_REFS_SQL = "[" + ", ".join(dlit(r) for r in REFS) + "]"
_T = dlit(BOUNDS_THRESHOLD)


def _export(spark, sf_dir):
    return curated_export(spark, sf_dir)


def _quantile_ctes(src: str = "export") -> str:
    return f""",
qv AS (SELECT quantile_cont(CAST(accuracy AS DOUBLE), {_REFS_SQL}) AS qs FROM {src}),
qt AS (SELECT unnest(range(0, {NQ})) AS k, unnest({_REFS_SQL}) AS reference, unnest(qs) AS quantile
       FROM qv),
knots AS (SELECT quantile AS q, min(reference) AS r_lo, max(reference) AS r_hi
          FROM qt GROUP BY quantile),
knots2 AS (SELECT q, r_lo, r_hi, lead(q) OVER (ORDER BY q) AS q_next,
                  lead(r_lo) OVER (ORDER BY q) AS r_next FROM knots),
qb AS (SELECT min(quantile) AS q_first, max(quantile) AS q_last FROM qt),
xs AS (SELECT e.*, CAST(accuracy AS DOUBLE) AS x FROM {src} e),
xj AS (SELECT xs.*, k.q, k.r_lo, k.r_hi, k.q_next, k.r_next
       FROM xs ASOF LEFT JOIN knots2 k ON xs.x >= k.q),
xu AS (SELECT xj.*, CASE
         WHEN x IS NULL THEN NULL
         WHEN x - {_T} < q_first THEN 0.0
         WHEN x + {_T} > q_last THEN 1.0
         WHEN x = q THEN 0.5 * (r_lo + r_hi)
         ELSE 0.5 * ((((r_next - r_hi) / (q_next - q)) * (x - q) + r_hi)
                     - (((r_next - r_hi) / (q_next - q)) * (q_next - x) - r_next))
       END AS u FROM xj, qb),
xz AS (SELECT xu.*, CASE
         WHEN u IS NULL THEN NULL
         WHEN u <= 0 THEN {dlit(CLIP_LOW)}
         WHEN u >= 1 THEN {dlit(CLIP_HIGH)}
         ELSE least(greatest({inv_cdf_sql('u')}, {dlit(CLIP_LOW)}), {dlit(CLIP_HIGH)})
       END AS y FROM xu),
refs2 AS (SELECT reference AS r, quantile AS q, lead(reference) OVER (ORDER BY k) AS r_next,
                 lead(quantile) OVER (ORDER BY k) AS q_next FROM qt),
yp AS (SELECT xz.*, {cdf_sql('y')} AS p FROM xz),
yj AS (SELECT yp.mid, yp.uid, yp.accuracy, yp.y, yp.p, r2.r, r2.q AS qk, r2.r_next AS rn,
              r2.q_next AS qn
       FROM yp ASOF LEFT JOIN refs2 r2 ON yp.p >= r2.r),
yb AS (SELECT yj.*, CASE
         WHEN p IS NULL THEN NULL
         WHEN p - {_T} < 0 THEN q_first
         WHEN p + {_T} > 1 THEN q_last
         WHEN rn IS NULL THEN qk
         ELSE ((qn - qk) / (rn - r)) * (p - r) + qk
       END AS back FROM yj, qb)"""


def _qsql(select: str) -> str:
    return with_curation(_quantile_ctes() + "\n" + select)


@register("label_codes", with_curation(
    "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code "
    "FROM (SELECT DISTINCT uid AS label FROM export)"))
def q_label_codes(spark, sf_dir):
    """Sorted dense codes of the user keys ("<uid>/<year>")."""
    return FT.label_codes(_export(spark, sf_dir), "uid")


@register("label_decode", with_curation(
    "SELECT DISTINCT code AS mid_le, label AS mid_back FROM "
    "(SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code "
    " FROM (SELECT DISTINCT mid AS label FROM export))"))
def q_label_decode(spark, sf_dir):
    """Encode the item keys of every row, decode the codes back (identity)."""
    e = _export(spark, sf_dir)
    codes = FT.label_codes(e, "mid")
    enc = FT.encode(e, "mid", codes, "mid_le")
    return FT.decode(enc.select("mid_le"), "mid_le", codes, "mid_back").distinct()


@register("quantile_table", _qsql(
    f"SELECT CAST(k AS INTEGER) AS k, {fixed_sql('reference')} AS reference, "
    f"{fixed_sql('quantile')} AS quantile FROM qt"))
def q_quantile_table(spark, sf_dir):
    qm = FT.fit_quantiles(_export(spark, sf_dir), "accuracy", NQ)
    t = qm.table(spark)
    return t.select("k", fixed(F.col("reference")).alias("reference"),
                    fixed(F.col("quantile")).alias("quantile"))


@register("quantile_normalize", _qsql(
    f"SELECT mid, uid, accuracy, {fixed_sql('y')} AS y FROM xz"))
def q_quantile_normalize(spark, sf_dir):
    e = _export(spark, sf_dir)
    qm = FT.fit_quantiles(e, "accuracy", NQ)
    return FT.normalize(e, "accuracy", qm, "y").select(
        "mid", "uid", "accuracy", fixed(F.col("y")).alias("y"))


@register("quantile_inverse", _qsql(
    f"SELECT mid, uid, accuracy, {fixed_sql('back')} AS back FROM yb"))
def q_quantile_inverse(spark, sf_dir):
    e = _export(spark, sf_dir)
    qm = FT.fit_quantiles(e, "accuracy", NQ)
    z = FT.normalize(e, "accuracy", qm, "y")
    return FT.inverse(z, "y", qm, "back").select(
        "mid", "uid", "accuracy", fixed(F.col("back")).alias("back"))


@register("split_sizes", with_curation(
    "SELECT part, n FROM (SELECT count(*) AS c FROM export) t, LATERAL (VALUES "
    f"('train', CAST(floor(CAST(c AS DOUBLE) * {dlit(0.8)}) AS BIGINT)), "
    f"('test', CAST(floor(CAST(c AS DOUBLE) * {dlit(0.1)}) AS BIGINT)), "
    f"('val', c - CAST(floor(CAST(c AS DOUBLE) * {dlit(0.8)}) AS BIGINT) "
    f"- CAST(floor(CAST(c AS DOUBLE) * {dlit(0.1)}) AS BIGINT))) v(part, n)"))
def q_split_sizes(spark, sf_dir):
    s = FT.exact_split(_export(spark, sf_dir), (0.8, 0.1, 0.1), 373)
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def split_ctes(src: str = "export", seed: int = 373) -> str:
    """``split``: rows of ``src`` with their part, as ``features.exact_split``."""
    return f""",
sh AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(concat_ws('|', '{seed}', mid, uid)), 1, 15) AS BIGINT),
              mid, uid, accuracy) - 1 AS i, count(*) OVER () AS c FROM {src}),
split AS (SELECT * EXCLUDE (i, c), CASE WHEN i < floor(CAST(c AS DOUBLE) * {dlit(0.8)}) THEN 'train'
          WHEN i < floor(CAST(c AS DOUBLE) * {dlit(0.8)}) + floor(CAST(c AS DOUBLE) * {dlit(0.1)}) THEN 'test'
          ELSE 'val' END AS part FROM sh)"""


def codes_ctes() -> str:
    return "".join(f""",
{x}_codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code
              FROM (SELECT DISTINCT {x} AS label FROM export))""" for x in ("uid", "mid"))


@register("exact_split", with_curation(split_ctes() + "\nSELECT mid, uid, accuracy, part FROM split"))
def q_exact_split(spark, sf_dir):
    """Every curated row with its part (seeded, exact sizes)."""
    return FT.exact_split(_export(spark, sf_dir), (0.8, 0.1, 0.1), 373)


@register("training_table", _qsql("").rstrip() + split_ctes("xz") + codes_ctes() + f"""
SELECT s.mid, s.uid, s.accuracy, {fixed_sql('s.y')} AS y, u.code AS uid_le, m.code AS mid_le, s.part
FROM split s JOIN uid_codes u ON u.label = s.uid JOIN mid_codes m ON m.label = s.mid""")
def q_training_table(spark, sf_dir):
    rows = training_table(_export(spark, sf_dir), TrainConfig()).rows
    return rows.withColumn("y", fixed(F.col("y")))

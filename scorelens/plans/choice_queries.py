"""Queries of the factorisation machine (M6b) and of the played bitmaps (J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import fm as FM
from ..operators import model as MD
from ..operators import played as PL
from .curation_queries import export as curated_export
from .curation_sql import with_curation
from .evaluation_queries import _once, _split_sql, _trained
from .feature_queries import codes_ctes
from .registry import register

_CODES = with_curation(codes_ctes() + "\n")


def _choice(spark, sf_dir):
    """Both models fitted on the train part, compared on the normalised scale of the others."""
    def build():
        tr = _trained(spark, sf_dir)
        rows = tr.table.rows.select("uid", "mid", "y", "part")
        held = rows.where("part <> 'train'")
        j = MD.keyed(tr.model, held, "uid", "mid", "null")
        z = MD.base_value(tr.model) + F.lit(tr.model.shrink) * F.coalesce(MD._dot(tr.model.params["rank"]), F.lit(0.0))
        fm = FM.fit(rows.where("part = 'train'"))
        return FM.compare({"als": j.select("part", "y", z.alias("pred")), "fm": FM.predict(fm, held)})
    return _once("model_choice", spark, sf_dir, build)


@register("model_choice_summary", _split_sql(
    "SELECT m.model, s.part, count(*) AS n, count(*) AS finite FROM split s, (VALUES ('als'), ('fm')) m(model) "
    "WHERE s.part <> 'train' GROUP BY m.model, s.part"))
def q_model_choice_summary(spark, sf_dir):
    """Rows and finite predictions of each model and part."""
    return _choice(spark, sf_dir).select("model", "part", "n", "finite")


@register("model_choice")
def q_model_choice(spark, sf_dir):
    """Losses of both models and the one chosen by validation loss."""
    return _choice(spark, sf_dir)


def _played(spark, sf_dir):
    export = curated_export(spark, sf_dir)
    codes = FT.label_codes(export, "mid")
    return export, codes, PL.bitmaps(export, codes)


@register("unplayed_buckets", _CODES +
          "SELECT uid, bucket, n_played, size - n_played AS n_unplayed FROM "
          "(SELECT e.uid, 1 + m.code // 32768 AS bucket, count(DISTINCT e.mid) AS n_played "
          "FROM export e JOIN mid_codes m ON m.label = e.mid GROUP BY ALL) "
          "JOIN (SELECT 1 + code // 32768 AS bucket, count(*) AS size FROM mid_codes GROUP BY ALL) USING (bucket)")
def q_unplayed_buckets(spark, sf_dir):
    """J11: played and unplayed items per user and bucket of item codes."""
    _, codes, maps = _played(spark, sf_dir)
    return PL.counts(maps, codes)


@register("played_next", _CODES +
          "SELECT DISTINCT e.uid, n.label AS mid, EXISTS (SELECT 1 FROM export x WHERE x.uid = e.uid AND x.mid = n.label) AS played "
          "FROM export e JOIN mid_codes m ON m.label = e.mid JOIN mid_codes n ON n.code = m.code + 1")
def q_played_next(spark, sf_dir):
    """J11 as a set that is asked: for each played item, whether the user played the next one too."""
    export, codes, maps = _played(spark, sf_dir)
    nxt = codes.select((F.col("code") - 1).alias("code"), F.col("label").alias("next"))
    pairs = (export.select("uid", F.col("mid").alias("label")).join(codes, "label").join(nxt, "code")
             .select("uid", F.col("next").alias("mid")).distinct())
    return PL.is_played(pairs, maps, codes)

"""Registered queries: scans, scalar expressions, predicates, joins and
aggregates of the curation stage (SURVEY §2.1-2.5), each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE_CURATION, CurationConfig
from ..functions import fixed, fixed_sql, speed_deviation, weighted_accuracy
from ..functions.curves import speed_deviation_sql
from ..functions.scores import WEIGHT_DENOMINATOR_GAME, WEIGHTS_GAME
from ..operators import curate as C
from ..operators.metric import scroll_variance
from ..sources import fixture
from ..sources.tables import read_table
from .curation import code_hash, curated_dataset, curation_stages, dataset_name, funnel
from .curation_sql import accuracy_sql, svness_ctes, with_curation
from .registry import register

CFG = FIXTURE_CURATION


def stages(spark, sf_dir, cfg: CurationConfig = CFG, stage_mode: str = "table",
           export_stage_mode: str | None = None):
    return curation_stages(fixture.scores(spark, sf_dir), fixture.items(spark, sf_dir),
                           fixture.steps(spark, sf_dir), cfg, stage_mode,
                           export_stage_mode=export_stage_mode)


def export(spark, sf_dir, cfg: CurationConfig = CFG, refresh: bool = False):
    """The curated training set of ``sf_dir``, built once and reused (the
    dataset-exists check of the reference's run script)."""
    return curated_dataset(spark, sf_dir,
                           lambda: stages(spark, sf_dir, cfg, export_stage_mode="none").export,
                           cfg, refresh)


# ---------------------------------------------------------------- sources
@register("scan_scores", with_curation("SELECT * FROM scores"))
def scan_scores(spark, sf_dir):
    return fixture.scores(spark, sf_dir)


@register("scan_items", with_curation("SELECT * FROM items"))
def scan_items(spark, sf_dir):
    return fixture.items(spark, sf_dir)


# ---------------------------------------------------------------- projections
@register("weighted_accuracy",
          with_curation("SELECT score_id, accuracy_320 FROM derived"))
def q_weighted_accuracy(spark, sf_dir):
    return fixture.scores(spark, sf_dir).select("score_id", weighted_accuracy().alias("accuracy_320"))


@register("accuracy_two_schemes", with_curation(
    f"SELECT score_id, {fixed_sql(accuracy_sql())} AS acc_320, "
    f"{fixed_sql(accuracy_sql(WEIGHTS_GAME, WEIGHT_DENOMINATOR_GAME))} AS acc_game FROM scores"))
def q_accuracy_two_schemes(spark, sf_dir):
    s = fixture.scores(spark, sf_dir)
    return s.select("score_id",
                    fixed(weighted_accuracy(as_float=False)).alias("acc_320"),
                    fixed(weighted_accuracy(weights=WEIGHTS_GAME, denominator=WEIGHT_DENOMINATOR_GAME,
                                            as_float=False)).alias("acc_game"))


@register("speed_class", with_curation("SELECT score_id, enabled_mods, speed FROM derived"))
def q_speed_class(spark, sf_dir):
    return C.derived_columns(fixture.scores(spark, sf_dir)).select("score_id", "enabled_mods", "speed")


@register("derived_columns", with_curation("SELECT * FROM derived"))
def q_derived_columns(spark, sf_dir):
    return C.derived_columns(fixture.scores(spark, sf_dir))


@register("speed_deviation", with_curation(
    f"SELECT mid, \"offset\", speed, {fixed_sql(speed_deviation_sql('speed'))} AS deviation "
    f"FROM steps_events"))
def q_speed_deviation(spark, sf_dir):
    s = fixture.steps_events(spark, sf_dir)
    return s.select("mid", "offset", "speed", fixed(speed_deviation("speed")).alias("deviation"))


# ---------------------------------------------------------------- predicates / joins
@register("prepared_scores", with_curation("SELECT * FROM prepared"))
def q_prepared_scores(spark, sf_dir):
    return C.prepare_scores(fixture.scores(spark, sf_dir), CFG)


@register("eligible_scores", with_curation(
    "SELECT speed, count(*) AS n_scores, min(accuracy) AS min_accuracy, "
    "max(accuracy) AS max_accuracy FROM prepared GROUP BY speed"))
def q_eligible_scores(spark, sf_dir):
    p = C.prepare_scores(fixture.scores(spark, sf_dir), CFG)
    return p.groupBy("speed").agg(F.count(F.lit(1)).alias("n_scores"),
                                  F.min("accuracy").alias("min_accuracy"),
                                  F.max("accuracy").alias("max_accuracy"))


@register("eligible_items", with_curation("SELECT * FROM eligible"))
def q_eligible_items(spark, sf_dir):
    return C.eligible_items(fixture.items(spark, sf_dir), CFG)


@register("item_scores", with_curation("SELECT * FROM item_scores"))
def q_item_scores(spark, sf_dir):
    return stages(spark, sf_dir, stage_mode="none").scored


@register("active_items", with_curation("SELECT * FROM active_items"))
def q_active_items(spark, sf_dir):
    return stages(spark, sf_dir, stage_mode="none").active_items


@register("active_users", with_curation("SELECT * FROM active_users"))
def q_active_users(spark, sf_dir):
    return stages(spark, sf_dir, stage_mode="none").active_users


@register("distinct_items", with_curation("SELECT * FROM metric_keys"))
def q_distinct_items(spark, sf_dir):
    return C.distinct_items(stages(spark, sf_dir, stage_mode="none").active_items)


@register("scroll_variance", "WITH " + fixture.STEPS_EVENTS_SQL + ",\n"
          "keys AS (SELECT DISTINCT mid FROM steps_events),\n"
          + svness_ctes("keys", "steps_events", "sv")
          + f"\nSELECT mid, {fixed_sql('svness')} AS svness FROM sv")
def q_scroll_variance(spark, sf_dir):
    sv = scroll_variance(fixture.steps_events(spark, sf_dir), "mid")
    return sv.select("mid", fixed(F.col("svness")).alias("svness"))


@register("item_metric_left", with_curation(
    f"SELECT e.mid, {fixed_sql('m.svness')} AS svness FROM eligible e "
    f"LEFT JOIN item_metric m ON e.mid = m.mid"))
def q_item_metric_left(spark, sf_dir):
    st = stages(spark, sf_dir, stage_mode="none")
    keys = st.eligible
    m = st.metric
    return keys.join(m, "mid", "left").select("mid", fixed(F.col("svness")).alias("svness"))


@register("low_variance_items", with_curation("SELECT * FROM low_variance"))
def q_low_variance_items(spark, sf_dir):
    return stages(spark, sf_dir, export_stage_mode="none").low_variance


@register("curated_scores", with_curation("SELECT * FROM curated"))
def q_curated_scores(spark, sf_dir):
    return stages(spark, sf_dir, export_stage_mode="none").curated


_BY_YEAR = CurationConfig(**{**CFG.__dict__, "user_key": "uid_year"})


@register("curated_scores_by_year", with_curation("SELECT * FROM curated", _BY_YEAR))
def q_curated_scores_by_year(spark, sf_dir):
    return stages(spark, sf_dir, _BY_YEAR, export_stage_mode="none").curated


@register("curate_dataset", with_curation("SELECT * FROM export"))
def q_curate_dataset(spark, sf_dir):
    """The flagship: always computed from the source tables, then published
    under its configuration name for the jobs that read the training set."""
    return export(spark, sf_dir, refresh=True)


@register("curation_funnel", with_curation(
    "SELECT '0_scores' AS stage, count(*) AS n_rows FROM scores UNION ALL "
    "SELECT '1_accuracy_in_range', count(*) FROM prepared UNION ALL "
    "SELECT '2_eligible_items', count(*) FROM eligible UNION ALL "
    "SELECT '3_item_scores', count(*) FROM item_scores UNION ALL "
    "SELECT '4_active_items', count(*) FROM active_items UNION ALL "
    "SELECT '5_active_users', count(*) FROM active_users UNION ALL "
    "SELECT '6_low_variance_items', count(*) FROM low_variance UNION ALL "
    "SELECT '7_curated', count(*) FROM curated"))
def q_curation_funnel(spark, sf_dir):
    st = stages(spark, sf_dir, export_stage_mode="none")
    return funnel(st, fixture.scores(spark, sf_dir), CFG)


# ---------------------------------------------------------------- checks
@register("duplicate_ids", with_curation(
    "SELECT sid, count(*) AS n FROM item_scores GROUP BY sid HAVING count(*) > 1"))
def q_duplicate_ids(spark, sf_dir):
    s = stages(spark, sf_dir, stage_mode="none").scored
    return s.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


_NULL_COLS = ("sid", "mid", "speed", "uid", "accuracy", "year")


@register("null_report", with_curation(
    "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_{c}"
                          for c in _NULL_COLS)
    + ", count(*) AS n_rows FROM (SELECT CAST(score_id AS BIGINT) AS sid, "
      "CAST(beatmap_id AS BIGINT) AS mid, speed, CAST(user_id AS BIGINT) AS uid, "
      "accuracy_320 AS accuracy, CAST(year(date) AS INTEGER) AS year FROM derived)"))
def q_null_report(spark, sf_dir):
    """NOT NULL check of the six stored columns, before the range filter (so a
    score with no judgements shows up as a NULL accuracy)."""
    d = C.derived_columns(fixture.scores(spark, sf_dir)).select(
        F.col("score_id").cast("bigint").alias("sid"), F.col("beatmap_id").cast("bigint").alias("mid"),
        "speed", F.col("user_id").cast("bigint").alias("uid"), F.col("accuracy_320").alias("accuracy"),
        F.year("date").cast("int").alias("year"))
    return d.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{c}") for c in _NULL_COLS],
                 F.count(F.lit(1)).alias("n_rows"))


@register("dataset_summary", with_curation(
    "SELECT count(*) AS n_rows, count(DISTINCT uid) AS n_users, count(DISTINCT mid) AS n_items, "
    "count(DISTINCT uid) * count(DISTINCT mid) AS n_possible_pairs, "
    "count(DISTINCT uid) * count(DISTINCT mid) - count(DISTINCT (uid, mid)) AS n_unplayed_pairs "
    "FROM export"))
def q_dataset_summary(spark, sf_dir):
    e = export(spark, sf_dir)
    return e.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct("uid").alias("n_users"),
                 F.count_distinct("mid").alias("n_items"),
                 (F.count_distinct("uid") * F.count_distinct("mid")).alias("n_possible_pairs"),
                 (F.count_distinct("uid") * F.count_distinct("mid")
                  - F.count_distinct("uid", "mid")).alias("n_unplayed_pairs"))


# ---------------------------------------------------------------- naming
@register("config_key", (
    "SELECT 'fixture' AS source, concat_ws('_', 'fixture', substr(md5('fixture|'), 1, 8), "
    "substr(md5(concat_ws('|', "
    + ", ".join(f"'{v}'" for v in CFG.params()) + f", '{CFG.user_key}', '{CFG.playmode}', '{CFG.key_counts}'"
    + f")), 1, 8), substr(md5('{code_hash()}'), 1, 8)) AS dataset_name, count(*) AS n_rows "
    "FROM lineitem"))
def q_config_key(spark, sf_dir):
    """The name that the jobs give the curated dataset of a source called ``fixture``,
    without its inputs' fingerprint (file times differ); one row, with the rows of its
    largest table."""
    li = read_table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))
    return li.select(F.lit("fixture").alias("source"), F.lit(dataset_name("fixture", CFG)).alias("dataset_name"), "n_rows")

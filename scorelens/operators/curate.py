"""Curation operators: from the raw score log and item catalogue to the
``(item key, user key, accuracy)`` training set.

Every function takes and returns DataFrames and only declares the plan.
Joins against derived key sets are written as ``left_semi`` joins: the
reference's inner joins followed by DISTINCT give the same rows, and a semi
join cannot fan out.  No broadcast is forced on data-derived tables: AQE turns
a join into a broadcast join only after it has measured the small side
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), otherwise it stays a
shuffle join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions.scores import composite_key, speed_class, weighted_accuracy

SCORE_COLUMNS = ("sid", "mid", "speed", "uid", "accuracy", "year")


def derived_columns(scores: DataFrame) -> DataFrame:
    """Add ``accuracy_320`` and ``speed`` to the score log (replacing any
    earlier copies, so a re-run is safe)."""
    return (scores.drop("accuracy_320", "speed")
            .withColumns({"accuracy_320": weighted_accuracy(), "speed": speed_class()}))


def prepare_scores(scores: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Renamed, typed scores whose 32-bit accuracy lies in [acc_min, acc_max].

    The bound test runs on the float value, as the reference stores it; a score
    with no judgements has NULL accuracy and is dropped by the range test.
    """
    s = derived_columns(scores)
    return (s.select(
        F.col("score_id").cast("bigint").alias("sid"),
        F.col("beatmap_id").cast("bigint").alias("mid"),
        F.col("speed").cast("int").alias("speed"),
        F.col("accuracy_320").alias("accuracy"),
        F.col("user_id").cast("bigint").alias("uid"),
        F.year("date").cast("int").alias("year"))
        .where(F.col("accuracy").between(cfg.acc_min, cfg.acc_max)))


def eligible_items(items: DataFrame, cfg: CurationConfig) -> DataFrame:
    return (items.where((F.col("playmode") == cfg.playmode)
                        & F.col("diff_size").isin(*cfg.key_counts)
                        & F.col("difficultyrating").between(cfg.sr_min, cfg.sr_max))
            .select(F.col("beatmap_id").cast("bigint").alias("mid")))


def item_scores(prepared: DataFrame, eligible: DataFrame) -> DataFrame:
    """Scores on eligible items.  ``eligible`` carries only ``mid``, so the
    reference's inner join equals a semi join (and cannot duplicate rows if
    the catalogue repeats an id)."""
    return prepared.join(eligible, "mid", "left_semi").select(*SCORE_COLUMNS)


def active_items(scored: DataFrame, cfg: CurationConfig) -> DataFrame:
    """(mid, speed) with strictly more than ``min_scores_per_mid`` scores."""
    return (scored.groupBy("mid", "speed").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > cfg.min_scores_per_mid).select("mid", "speed"))


def active_users(scored: DataFrame, cfg: CurationConfig) -> DataFrame:
    """(uid, year) with strictly more than ``min_scores_per_uid`` scores."""
    return (scored.groupBy("uid", "year").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > cfg.min_scores_per_uid).select("uid", "year"))


def distinct_items(active: DataFrame) -> DataFrame:
    return active.select("mid").distinct()


def low_variance_items(active: DataFrame, metric: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Active (mid, speed) whose item metric is strictly below ``max_svness``;
    a NULL metric (no step data) drops the item."""
    return (active.join(metric.select("mid", "svness"), "mid")
            .where(F.col("svness") < cfg.max_svness).select("mid", "speed"))


def curated_scores(scored: DataFrame, low_var: DataFrame, users: DataFrame,
                   cfg: CurationConfig) -> DataFrame:
    """Scores on low-variance items by active users, deduplicated over all six
    columns.  ``user_key='uid'`` matches on the player only (the reference's
    SQL); ``'uid_year'`` requires activity in that year."""
    if cfg.user_key == "uid":
        user_side, user_on = users.select("uid"), ["uid"]
    elif cfg.user_key == "uid_year":
        user_side, user_on = users.select("uid", "year"), ["uid", "year"]
    else:
        raise ValueError(f"user_key must be 'uid' or 'uid_year', not {cfg.user_key!r}")
    return (scored.join(low_var, ["mid", "speed"], "left_semi")
            .join(user_side, user_on, "left_semi")
            .dropDuplicates(list(SCORE_COLUMNS)))


def export_dataset(curated: DataFrame) -> DataFrame:
    """``mid = "<mid>/<speed>"``, ``uid = "<uid>/<year>"``, accuracy."""
    return curated.select(composite_key("mid", "speed").alias("mid"),
                          composite_key("uid", "year").alias("uid"),
                          F.col("accuracy"))

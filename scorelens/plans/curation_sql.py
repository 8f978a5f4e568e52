"""SQL mirrors of the curation stages, as CTE text for the DuckDB oracle.

Each CTE computes the same rows and types as the Spark operator of the same
name.  Float accuracy is compared against DOUBLE bounds, as Spark does.
"""

from __future__ import annotations

from ..config import FIXTURE_CURATION, CurationConfig
from ..functions.curves import speed_deviation_sql
from ..functions.numeric import dlit
from ..functions.scores import (DOUBLE_TIME_BIT, HALF_TIME_BIT, JUDGEMENT_COLUMNS,
                                WEIGHT_DENOMINATOR_320, WEIGHTS_320)
from ..sources.fixture import ITEMS_SQL, SCORES_SQL, STEPS_EVENTS_SQL, STEPS_SQL


def accuracy_sql(weights=WEIGHTS_320, denominator=WEIGHT_DENOMINATOR_320,
                 counts=JUDGEMENT_COLUMNS) -> str:
    terms = []
    for c, w in zip(counts, weights):
        if w == 0:
            continue
        terms.append(c if w == denominator else f"{c} * {w} / {denominator}")
    num = " + ".join(terms)
    den = " + ".join(counts)
    return f"(CAST({num} AS DOUBLE) / NULLIF({den}, 0))"


SPEED_SQL = (f"CAST(CASE WHEN (enabled_mods >> {HALF_TIME_BIT}) & 1 = 1 THEN -1 "
             f"WHEN (enabled_mods >> {DOUBLE_TIME_BIT}) & 1 = 1 THEN 1 ELSE 0 END AS INTEGER)")


def _d(x: float) -> str:
    return dlit(x)


def svness_ctes(keys_cte: str, steps_name: str = "steps", out: str = "sv") -> str:
    """Plain ``lead`` window per key (the oracle need not be skew-safe)."""
    dev = speed_deviation_sql("v")
    return f"""{out}_st AS (
  SELECT s.mid, CAST(s.offset AS DOUBLE) AS o, s.speed AS v FROM {steps_name} s
  WHERE s.offset IS NOT NULL AND s.mid IN (SELECT mid FROM {keys_cte})),
{out}_len AS (
  SELECT mid, o, v, lead(o) OVER (PARTITION BY mid ORDER BY o, v) - o AS len FROM {out}_st),
{out} AS (
  SELECT mid, CASE WHEN count(*) = 1 THEN 0.0
              ELSE sum(CASE WHEN len IS NOT NULL THEN {dev} * len END) / NULLIF(max(o) - min(o), 0)
              END AS svness
  FROM {out}_len GROUP BY mid)"""


def curation_ctes(cfg: CurationConfig = FIXTURE_CURATION) -> str:
    """All curation stages as one WITH list (without the WITH keyword)."""
    user_join = ("u.uid = s.uid" if cfg.user_key == "uid"
                 else "u.uid = s.uid AND u.year = s.year")
    keys = ", ".join(str(k) for k in cfg.key_counts)
    return f"""{SCORES_SQL},
{ITEMS_SQL},
{STEPS_SQL},
{STEPS_EVENTS_SQL},
derived AS (
  SELECT *, CAST({accuracy_sql()} AS FLOAT) AS accuracy_320, {SPEED_SQL} AS speed FROM scores),
prepared AS (
  SELECT CAST(score_id AS BIGINT) AS sid, CAST(beatmap_id AS BIGINT) AS mid, speed,
         accuracy_320 AS accuracy, CAST(user_id AS BIGINT) AS uid,
         CAST(year(date) AS INTEGER) AS year
  FROM derived
  WHERE CAST(accuracy_320 AS DOUBLE) BETWEEN {_d(cfg.acc_min)} AND {_d(cfg.acc_max)}),
eligible AS (
  SELECT CAST(beatmap_id AS BIGINT) AS mid FROM items
  WHERE playmode = {cfg.playmode} AND diff_size IN ({keys})
    AND difficultyrating BETWEEN {_d(cfg.sr_min)} AND {_d(cfg.sr_max)}),
item_scores AS (
  SELECT sid, mid, speed, uid, accuracy, year FROM prepared
  WHERE mid IN (SELECT mid FROM eligible)),
active_items AS (
  SELECT mid, speed FROM item_scores GROUP BY mid, speed HAVING count(*) > {cfg.min_scores_per_mid}),
active_users AS (
  SELECT uid, year FROM item_scores GROUP BY uid, year HAVING count(*) > {cfg.min_scores_per_uid}),
metric_keys AS (SELECT DISTINCT mid FROM active_items),
{svness_ctes("metric_keys", "steps", "sv")},
item_metric AS (
  SELECT k.mid, sv.svness FROM metric_keys k LEFT JOIN sv ON k.mid = sv.mid),
low_variance AS (
  SELECT a.mid, a.speed FROM active_items a JOIN item_metric m ON a.mid = m.mid
  WHERE m.svness < {_d(cfg.max_svness)}),
curated AS (
  SELECT DISTINCT sid, mid, speed, uid, accuracy, year FROM item_scores s
  WHERE EXISTS (SELECT 1 FROM low_variance l WHERE l.mid = s.mid AND l.speed = s.speed)
    AND EXISTS (SELECT 1 FROM active_users u WHERE {user_join})),
export AS (
  SELECT CONCAT(CAST(mid AS VARCHAR), '/', CAST(speed AS VARCHAR)) AS mid,
         CONCAT(CAST(uid AS VARCHAR), '/', CAST(year AS VARCHAR)) AS uid,
         accuracy
  FROM curated)"""


def with_curation(select: str, cfg: CurationConfig = FIXTURE_CURATION) -> str:
    return f"WITH {curation_ctes(cfg)}\n{select}"

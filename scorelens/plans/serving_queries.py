"""Registered queries: request grid, lookups and the prediction grid
(SURVEY §2.2 P6/P11/P12, §2.3 F6-F8, §2.4 J9-J11, §2.5 A12/A15, M3c, O6, C5).

Requests come from ``events``: user ``user_id``, item ``props.k``.  Keys
without a model use a deterministic stand-in predictor, the item key's mean
accuracy over the curated set, so DuckDB can check them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, item_title, json_first, key_part
from ..functions.numeric import fixed_sql
from ..operators import features as FT
from ..operators import model as MD
from ..operators import serve as SV
from ..sources import fixture
from ..sources.sinks import stage
from ..sources.tables import read_table
from .curation_queries import export as curated_export
from .curation_sql import curation_ctes, with_curation
from .evaluation_queries import _trained
from .registry import register

# Fixture parameter: the newest score year of the test tables.
MODEL_YEAR = 2001


def requests(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = json_first(F.concat(F.lit("["), F.col("props"), F.lit("]")), "struct<k:bigint>")["k"]
    return ev.select("event_id", F.col("user_id").cast("bigint").alias("user_id"),
                     k.alias("beatmap_id"), "event_type")


REQ_SQL = ("requests AS (SELECT event_id, CAST(user_id AS BIGINT) AS user_id, "
           "CAST(json_extract('[' || props || ']', '$[0].k') AS BIGINT) AS beatmap_id, event_type "
           "FROM events)")
GRID_SQL = f"""grid AS (
  SELECT r.*, s.speed, y.year,
         CONCAT(CAST(r.user_id AS VARCHAR), '/', CAST(y.year AS VARCHAR)) AS uid_key,
         CONCAT(CAST(r.beatmap_id AS VARCHAR), '/', CAST(s.speed AS VARCHAR)) AS mid_key,
         CASE s.speed WHEN -1 THEN 'HT' WHEN 0 THEN 'NT' WHEN 1 THEN 'DT' END AS speed_label
  FROM requests r CROSS JOIN (VALUES (-1), (0), (1)) s(speed)
  CROSS JOIN range({MODEL_YEAR - SV.YEARS_SEARCH}, {MODEL_YEAR + 1}) y(year)),
known AS (
  SELECT * FROM grid WHERE uid_key IN (SELECT uid FROM export) AND mid_key IN (SELECT mid FROM export)),
item_mean AS (SELECT mid, avg(CAST(accuracy AS DOUBLE)) AS pred FROM export GROUP BY mid),
scored AS (SELECT k.*, m.pred FROM known k JOIN item_mean m ON k.mid_key = m.mid
           WHERE m.pred IS NOT NULL AND m.pred <> 0),
latest AS (SELECT * FROM scored s
           WHERE year = (SELECT max(year) FROM scored s2 WHERE s2.event_id = s.event_id))"""


def _with_grid(select: str) -> str:
    return "WITH " + curation_ctes() + f",\n{REQ_SQL},\n{GRID_SQL}\n{select}"


def _labels(export):
    return (export.select(F.col("uid").alias("label")).distinct(),
            export.select(F.col("mid").alias("label")).distinct())


def _grid(spark, sf_dir):
    g = SV.request_grid(requests(spark, sf_dir), "user_id", "beatmap_id", MODEL_YEAR)
    return g.withColumn("year", F.col("year").cast("int")).withColumn("speed", F.col("speed").cast("int"))


def serving_tables(spark, sf_dir):
    """``(years, speeds)`` of the known keys; each speed carries its key's mean accuracy."""
    export = curated_export(spark, sf_dir)
    uids, _ = _labels(export)
    means = export.groupBy(F.col("mid").alias("label")).agg(F.avg(F.col("accuracy").cast("double")).alias("pred"))
    return SV.user_years(uids, MODEL_YEAR), SV.item_speeds(means, "pred")


def _scored(spark, sf_dir):
    return SV.truthy(SV.known_pairs(requests(spark, sf_dir), *serving_tables(spark, sf_dir)))


_GRID_COLS = "event_id, user_id, beatmap_id, event_type, speed, year, uid_key, mid_key, speed_label"


@register("request_grid", _with_grid(f"SELECT {_GRID_COLS} FROM grid"))
def q_request_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@register("known_pairs", _with_grid(f"SELECT {_GRID_COLS} FROM known"))
def q_known_pairs(spark, sf_dir):
    return SV.known_pairs(requests(spark, sf_dir), *serving_tables(spark, sf_dir)).drop("pred")


@register("latest_year", _with_grid(
    f"SELECT event_id, year, speed_label, {fixed_sql('pred')} AS pred FROM latest"))
def q_latest_year(spark, sf_dir):
    lat = SV.latest_year(_scored(spark, sf_dir), ["event_id"])
    return lat.select("event_id", "year", "speed_label", fixed(F.col("pred")).alias("pred"))


def _cmp_sql():
    cols = []
    for s, lab in ((-1, "HT"), (0, "NT"), (1, "DT")):
        cols.append(f"max(CASE WHEN speed = {s} THEN pred END) AS {lab}")
    return ("SELECT event_id, " + ", ".join(fixed_sql(c) + f" AS {c}" for c in ("HT", "NT", "DT"))
            + ", " + fixed_sql("HT - NT") + " AS delta_ht, " + fixed_sql("DT - NT") + " AS delta_dt, "
            "HT < NT AS ht_below_nt, DT > NT AS dt_above_nt FROM (SELECT event_id, "
            + ", ".join(cols) + " FROM latest GROUP BY event_id)")


@register("speed_comparison", _with_grid(_cmp_sql()))
def q_speed_comparison(spark, sf_dir):
    lat = SV.latest_year(_scored(spark, sf_dir), ["event_id"])
    c = SV.speed_comparison(lat, ["event_id"])
    return c.select("event_id", *[fixed(F.col(x)).alias(x) for x in ("HT", "NT", "DT", "delta_ht",
                                                                     "delta_dt")],
                    "ht_below_nt", "dt_above_nt")


@register("prediction_count", _with_grid(
    "SELECT (SELECT count(*) FROM requests) AS n_requests, count(*) AS n_predictions FROM scored"))
def q_prediction_count(spark, sf_dir):
    n_req = requests(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return _scored(spark, sf_dir).agg(n_req.alias("n_requests"),
                                      F.count(F.lit(1)).alias("n_predictions"))


@register("unknown_keys", _with_grid(
    "SELECT DISTINCT uid_key FROM grid WHERE uid_key NOT IN (SELECT uid FROM export)"))
def q_unknown_keys(spark, sf_dir):
    export = curated_export(spark, sf_dir)
    uids, _ = _labels(export)
    # A key of the grid depends on the user alone: each user is expanded once, whatever their requests.
    users = requests(spark, sf_dir).select("user_id").distinct().withColumn("beatmap_id", F.lit(None).cast("bigint"))
    g = SV.request_grid(users, "user_id", "beatmap_id", MODEL_YEAR).select("uid_key").distinct()
    return FT.unknown_labels(g, "uid_key", uids)


@register("unplayed_pairs", with_curation(
    "SELECT uid, count(DISTINCT mid) AS n_played, "
    "(SELECT count(DISTINCT mid) FROM export) - count(DISTINCT mid) AS n_unplayed "
    "FROM export GROUP BY uid"))
def q_unplayed_pairs(spark, sf_dir):
    return SV.unplayed_counts(curated_export(spark, sf_dir))


@register("decode_keys", with_curation(
    "SELECT DISTINCT uid, CAST(split_part(uid, '/', 1) AS INTEGER) AS user_id, "
    "split_part(uid, '/', 2) AS year FROM export"))
def q_decode_keys(spark, sf_dir):
    e = curated_export(spark, sf_dir)
    return e.select("uid", key_part("uid", 1, as_int=True).alias("user_id"),
                    key_part("uid", 2).alias("year")).distinct()


@register("item_title", "SELECT CAST(p_partkey AS BIGINT) AS beatmap_id, "
          "p_brand || ' - ' || p_name || ' (' || p_type || ') [' || CAST(p_size AS VARCHAR) || ']' "
          "AS title FROM part")
def q_item_title(spark, sf_dir):
    m = fixture.item_meta(spark, sf_dir)
    return m.select("beatmap_id", item_title("artist", "title", "creator", "version").alias("title"))


@register("json_first", "SELECT event_id, CAST(json_extract('[' || props || ']', '$[0].k') AS BIGINT) "
          "AS k FROM events")
def q_json_first(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    k = json_first(F.concat(F.lit("["), F.col("props"), F.lit("]")), "struct<k:bigint>")["k"]
    return ev.select("event_id", k.alias("k"))


@register("resolve_user", """WITH req AS (
  SELECT event_id, CASE WHEN event_type = 'click' THEN printf('Customer#%09d', user_id)
                        ELSE CAST(user_id AS VARCHAR) END AS user_text FROM events),
r AS (SELECT req.*, CASE WHEN regexp_full_match(user_text, '[0-9]+') THEN CAST(user_text AS BIGINT) END AS _id
      FROM req)
SELECT r.event_id, r.user_text,
       coalesce(cn.c_custkey, r._id) AS uid,
       coalesce(ci.c_name, CASE WHEN cn.c_custkey IS NOT NULL THEN r.user_text END) AS username
FROM r LEFT JOIN customer ci ON ci.c_custkey = r._id
       LEFT JOIN customer cn ON cn.c_name = r.user_text AND r._id IS NULL""")
def q_resolve_user(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    req = ev.select("event_id", F.when(F.col("event_type") == "click",
                                       F.format_string("Customer#%09d", "user_id"))
                    .otherwise(F.col("user_id").cast("string")).alias("user_text"))
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"),
                                                          F.col("c_name").alias("username"))
    return SV.resolve_user(req, "user_text", users)


@register("random_label", with_curation("SELECT label FROM (SELECT DISTINCT uid AS label FROM export) "
                                        "ORDER BY md5('42|' || label), label LIMIT 1"))
def q_random_label(spark, sf_dir):
    uids, _ = _labels(curated_export(spark, sf_dir))
    return SV.random_label(uids, 42)


def prediction_grid(tr, requests_with_text, users):
    """C5: resolve the users (J10), make the known (year, speed) pairs of each request, score
    them, keep real predictions of the latest year and compare the speeds; one row per request
    that has any, with the number of predictions made for it (A15)."""
    req = SV.resolve_user(requests_with_text, "user_text", users).withColumnRenamed("uid", "user_id")
    known = SV.known_pairs(req.where(F.col("user_id").isNotNull()), SV.user_years(tr.model.users, MODEL_YEAR),
                           SV.item_speeds(tr.model.items))
    scored = MD.predict(tr.model, known.select("event_id", "user_id", "username", "speed_label", "year", "uid_key", "mid_key"),
                        "uid_key", "mid_key", on_unknown="drop")
    # Both the comparison and the counts read the predictions: they are made once.
    scored = stage(SV.truthy(scored).drop("uid_key", "mid_key"), "grid_scored")
    key = ["event_id", "user_id", "username"]
    made = scored.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_predictions"))
    return SV.speed_comparison(SV.latest_year(scored, ["event_id"]), key).join(made, "event_id")


def _requests_with_text(spark, sf_dir):
    req = requests(spark, sf_dir)
    return req.select("event_id", "beatmap_id", F.when(F.col("event_type") == "click", F.format_string("Customer#%09d", "user_id"))
                      .otherwise(F.col("user_id").cast("string")).alias("user_text"))


def _users(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@register("prediction_grid")
def q_prediction_grid(spark, sf_dir):
    """C5 with the factor model (see ``prediction_grid``)."""
    return prediction_grid(_trained(spark, sf_dir), _requests_with_text(spark, sf_dir), _users(spark, sf_dir))


@register("prediction_grid_summary", "WITH " + curation_ctes() + f""",
req AS (SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type,
               CAST(json_extract('[' || props || ']', '$[0].k') AS BIGINT) AS beatmap_id FROM events),
res AS (SELECT req.* FROM req LEFT JOIN customer c ON c.c_custkey = req.user_id
        WHERE event_type <> 'click' OR c.c_custkey IS NOT NULL),
pairs AS (SELECT r.event_id, u.uid, m.mid FROM res r
          JOIN (SELECT DISTINCT uid FROM export) u ON CAST(split_part(u.uid, '/', 1) AS BIGINT) = r.user_id
           AND CAST(split_part(u.uid, '/', 2) AS INTEGER) BETWEEN {MODEL_YEAR - SV.YEARS_SEARCH} AND {MODEL_YEAR}
          JOIN (SELECT DISTINCT mid FROM export) m ON CAST(split_part(m.mid, '/', 1) AS BIGINT) = r.beatmap_id)
SELECT count(DISTINCT event_id) AS n_requests, count(*) AS n_predictions FROM pairs""")
def q_prediction_grid_summary(spark, sf_dir):
    """Requests with a prediction and predictions made by the prediction grid: every known pair
    has one."""
    g = prediction_grid(_trained(spark, sf_dir), _requests_with_text(spark, sf_dir), _users(spark, sf_dir))
    return g.agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum("n_predictions"), F.lit(0)).cast("bigint").alias("n_predictions"))

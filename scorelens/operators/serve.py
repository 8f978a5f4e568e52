"""Serving operators: expand requests, resolve users, keep predictable pairs,
compare speeds.

A request is ``(user, item)``; it expands to every (year, speed) of a fixed
window, a constant 33 rows per request (``explode`` of two literal arrays, not
a join).  Every other step is a join to a key table or a window over one
request's rows (at most 33), so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import SPEED_LABELS, composite_key, speed_label

# The window of years asked for (the model year and the ten
# before it) and the three speeds.
YEARS_SEARCH = 10
SPEEDS = (-1, 0, 1)


def request_grid(requests: DataFrame, uid_col: str, mid_col: str, model_year: int,
                 years_search: int = YEARS_SEARCH) -> DataFrame:
    years = F.sequence(F.lit(model_year - years_search), F.lit(model_year))
    speeds = F.array(*[F.lit(s) for s in SPEEDS])
    g = (requests.withColumn("speed", F.explode(speeds))
         .withColumn("year", F.explode(years)))
    return g.withColumns({"uid_key": composite_key(uid_col, "year"),
                          "mid_key": composite_key(mid_col, "speed"),
                          "speed_label": speed_label("speed")})


def user_years(uid_labels: DataFrame, model_year: int, years_search: int = YEARS_SEARCH) -> DataFrame:
    """``(user_id, years)``: the years of the window that each known user key has (at most
    ``years_search + 1``)."""
    year = F.split_part("label", F.lit("/"), F.lit(2)).cast("int")
    return (uid_labels.select(F.split_part("label", F.lit("/"), F.lit(1)).cast("bigint").alias("user_id"), year.alias("year"))
            .where(F.col("year").between(model_year - years_search, model_year))
            .groupBy("user_id").agg(F.sort_array(F.collect_set("year")).alias("years")))


def item_speeds(mid_labels: DataFrame, *payload: str) -> DataFrame:
    """``(beatmap_id, speeds)``: the speeds that each known item key has (at most three),
    as ``(speed, *payload)``."""
    speed = F.split_part("label", F.lit("/"), F.lit(2)).cast("int")
    return (mid_labels.select(F.split_part("label", F.lit("/"), F.lit(1)).cast("bigint").alias("beatmap_id"),
                              F.struct(speed.alias("speed"), *payload).alias("s"))
            .where(F.col("s.speed").isin(*SPEEDS)).groupBy("beatmap_id").agg(F.sort_array(F.collect_set("s")).alias("speeds")))


def known_pairs(requests: DataFrame, years: DataFrame, speeds: DataFrame, uid_col: str = "user_id",
                mid_col: str = "beatmap_id") -> DataFrame:
    """Grid rows whose user key and item key are both known: each request is joined once to
    its user's years and its item's speeds, so only known combinations are ever made.  Works
    on a stream of requests too."""
    y = years.select(F.col("user_id").alias(uid_col), "years")
    s = speeds.select(F.col("beatmap_id").alias(mid_col), "speeds")
    g = requests.join(y, uid_col).join(s, mid_col)
    g = g.select(*requests.columns, "years", F.explode("speeds").alias("_s")).select(
        *requests.columns, "_s.*", F.explode("years").alias("year"))
    return g.withColumns({"uid_key": composite_key(uid_col, "year"),
                          "mid_key": composite_key(mid_col, "speed"),
                          "speed_label": speed_label("speed")})


def truthy(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Keep rows with a prediction that is neither NULL nor 0."""
    return df.where(F.col(pred).isNotNull() & (F.col(pred) != 0))


def latest_year(df: DataFrame, group: list[str], year: str = "year") -> DataFrame:
    """Rows of each group whose year is the group's latest."""
    w = Window.partitionBy(*group)
    return df.withColumn("_max_year", F.max(year).over(w)) \
        .where(F.col(year) == F.col("_max_year")).drop("_max_year")


def speed_comparison(latest: DataFrame, group: list[str], pred: str = "pred") -> DataFrame:
    """One row per group: HT / NT / DT predictions, deltas to NT (NULL when NT
    or the speed is missing) and the two warning flags."""
    labels = list(SPEED_LABELS.values())
    p = latest.groupBy(*group).pivot("speed_label", labels).agg(F.max(pred))
    return p.select(*group, *labels,
                    (F.col("HT") - F.col("NT")).alias("delta_ht"),
                    (F.col("DT") - F.col("NT")).alias("delta_dt"),
                    (F.col("HT") < F.col("NT")).alias("ht_below_nt"),
                    (F.col("DT") > F.col("NT")).alias("dt_above_nt"))


def resolve_user(requests: DataFrame, text_col: str, users: DataFrame,
                 id_col: str = "user_id", name_col: str = "username") -> DataFrame:
    """Digits resolve by id, anything else by name; unresolved stay NULL, numbers beyond
    the id range too.  Of users with one name (or id) the smallest id (name) counts, so a
    request stays one row.  Each request is joined by the key it has, and requests without
    one are not joined at all: no NULL key gathers rows."""
    text = F.col(text_col)
    is_id = text.rlike("^[0-9]+$")
    own = requests.columns
    by_id = (users.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id"))
             .agg(F.min(name_col).alias("username")))
    by_name = (users.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("_name"))
               .agg(F.min(F.col(id_col).cast("bigint")).alias("uid")))
    number = F.expr(f"try_cast(`{text_col}` AS bigint)")
    ids = (requests.where(is_id & number.isNotNull()).withColumn("_id", number).join(by_id, "_id", "left")
           .select(*own, F.col("_id").alias("uid"), "username"))
    names = (requests.where(~is_id).withColumn("_name", text).join(by_name, "_name", "left")
             .select(*own, "uid", F.when(F.col("uid").isNotNull(), F.col("_name")).alias("username")))
    rest = requests.where(text.isNull() | (is_id & number.isNull())).select(
        *own, F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("string").alias("username"))
    return ids.unionByName(names).unionByName(rest)


def unplayed_counts(export: DataFrame, uid: str = "uid", mid: str = "mid") -> DataFrame:
    """Per user key: items played and items never played, counted without
    enumerating user x item pairs (all items minus the distinct played ones)."""
    n_items = export.select(F.count_distinct(mid)).scalar()
    played = export.groupBy(uid).agg(F.count_distinct(mid).alias("n_played"))
    return played.select(uid, "n_played", (n_items - F.col("n_played")).alias("n_unplayed"))


def random_label(labels: DataFrame, seed: int) -> DataFrame:
    """One label picked by a seeded hash order (reproducible, also by other engines)."""
    return labels.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "label")), "label").limit(1)

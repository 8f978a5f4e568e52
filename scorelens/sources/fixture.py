"""Views of the driver's test tables in the reference's shapes (FIXTURES.md §2).

* ``scores``  = lineitem JOIN orders: one score per line item;
* ``items``   = part: the item catalogue;
* ``steps``   = lineitem pre-aggregated per (part, ship date): a speed step table;
* ``steps_events`` = events as a step table keyed by user.

Each view has a Spark form and a SQL form (CTE text for the DuckDB oracle)
that compute the same columns with the same types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture mapping (FIXTURES.md): which line items carry
# which mod bits, and how counters derive from line-item numbers.
_MODS_SQL = ("(CASE WHEN l_linenumber = 7 THEN 320 WHEN l_returnflag = 'R' THEN 256 "
             "WHEN l_returnflag = 'A' THEN 64 ELSE 0 END "
             "+ CASE WHEN l_linestatus = 'F' THEN 8 ELSE 0 END)")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("score_id"),
        F.col("l_partkey").cast("bigint").alias("beatmap_id"),
        F.col("o_custkey").cast("bigint").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.expr(_MODS_SQL).cast("int").alias("enabled_mods"),
        (F.floor("l_extendedprice").cast("bigint") % 400 + 100).alias("countgeki"),
        F.floor("l_quantity").cast("bigint").alias("count300"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("countkatu"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("count100"),
        F.col("l_linenumber").cast("bigint").alias("count50"),
        (F.col("l_suppkey") % 10).cast("bigint").alias("countmiss"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("bigint").alias("beatmap_id"),
        F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(3).cast("int").alias("playmode"),
        F.when(F.col("p_size") % 3 == 0, 7).when(F.col("p_size") % 3 == 1, 4)
        .otherwise(5).cast("int").alias("diff_size"),
        (F.col("p_size") / 4.0).cast("double").alias("difficultyrating"),
    )


def item_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata for display strings: artist/title/creator/version from part."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("bigint").alias("beatmap_id"),
                    F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
                    F.col("p_type").alias("creator"), F.col("p_size").cast("string").alias("version"),
                    (F.col("p_size") / 4.0).cast("double").alias("difficultyrating"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_discount")
    return (li.groupBy("l_partkey", "l_shipdate")
            .agg((F.lit(0.5) + F.lit(10.0) * F.max("l_discount")).alias("speed"))
            .select(F.col("l_partkey").cast("bigint").alias("mid"),
                    F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("offset"),
                    F.col("speed").cast("double").alias("speed")))


def steps_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return ev.select(F.col("user_id").cast("bigint").alias("mid"),
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("offset"),
                     (F.col("value") / 100).cast("double").alias("speed"))


# ---------------------------------------------------------------- SQL mirrors
SCORES_SQL = f"""scores AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS score_id,
         CAST(l.l_partkey AS BIGINT) AS beatmap_id,
         CAST(o.o_custkey AS BIGINT) AS user_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS date,
         CAST({_MODS_SQL} AS INTEGER) AS enabled_mods,
         CAST(floor(l.l_extendedprice) AS BIGINT) % 400 + 100 AS countgeki,
         CAST(floor(l.l_quantity) AS BIGINT) AS count300,
         CAST(round(l.l_discount * 100) AS BIGINT) AS countkatu,
         CAST(round(l.l_tax * 100) AS BIGINT) AS count100,
         CAST(l.l_linenumber AS BIGINT) AS count50,
         CAST(l.l_suppkey % 10 AS BIGINT) AS countmiss
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

ITEMS_SQL = """items AS (
  SELECT CAST(p_partkey AS BIGINT) AS beatmap_id,
         CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 3 END AS INTEGER) AS playmode,
         CAST(CASE p_size % 3 WHEN 0 THEN 7 WHEN 1 THEN 4 ELSE 5 END AS INTEGER) AS diff_size,
         CAST(p_size / 4.0 AS DOUBLE) AS difficultyrating
  FROM part)"""

ITEM_META_SQL = """item_meta AS (
  SELECT CAST(p_partkey AS BIGINT) AS beatmap_id, p_brand AS artist, p_name AS title,
         p_type AS creator, CAST(p_size AS VARCHAR) AS version,
         CAST(p_size / 4.0 AS DOUBLE) AS difficultyrating
  FROM part)"""

STEPS_SQL = """steps AS (
  SELECT CAST(l_partkey AS BIGINT) AS mid,
         epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS offset,
         CAST(0.5 + 10.0 * max(l_discount) AS DOUBLE) AS speed
  FROM lineitem GROUP BY l_partkey, l_shipdate)"""

STEPS_EVENTS_SQL = """steps_events AS (
  SELECT CAST(user_id AS BIGINT) AS mid, epoch_us(CAST(ts AS TIMESTAMP)) AS offset,
         CAST(value / 100 AS DOUBLE) AS speed
  FROM events)"""

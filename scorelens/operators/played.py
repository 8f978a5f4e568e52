"""Played items as bitmaps (J11): which pairs of a user and an item were never played, without
listing a pair.

Items have dense codes, dealt into buckets of ``BITS`` codes; a bucket's complement is counted
from its size.  A user's played codes are bitmaps of ``WORD`` codes, one row for each word of a
bucket that the user has touched: a user has few items of a bucket, so whole buckets would be
4 KB of zeros each in every sort and shuffle.  Bitmaps of parts of a log merge by OR, so new
plays need no second read of the old.  A user's bitmaps are built from partial bitmaps
(map-side), so a hot user shuffles at most ``BITS / WORD`` rows per bucket and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32768  # codes in a bucket, as in Spark's bitmap functions (fixed value)
WORD = 64     # codes in a bitmap: the bits of a BIGINT


def _place(code):
    """Bucket (from 1), word in it (from 0) and that word with the bit of a code from 0."""
    at = F.bitmap_bit_position(code + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % WORD).cast("int"))
    return F.bitmap_bucket_number(code + 1), F.floor(at / WORD).cast("int"), bit


def bitmaps(plays: DataFrame, codes: DataFrame, uid: str = "uid", mid: str = "mid") -> DataFrame:
    """``(uid, bucket, word, bits)``; repeated plays count once, rows with a NULL or unknown key not."""
    bucket, word, bit = _place(F.col("code"))
    coded = plays.where(F.col(uid).isNotNull()).join(codes.select(F.col("label").alias(mid), "code"), mid)
    return coded.groupBy(uid, bucket.alias("bucket"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge(*parts: DataFrame, uid: str = "uid") -> DataFrame:
    """The bitmaps of all parts together (coded alike)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(uid, "bucket", "word").agg(F.bit_or("bits").alias("bits"))


def bucket_sizes(codes: DataFrame) -> DataFrame:
    """``(bucket, size)``: items of each bucket."""
    return codes.groupBy(_place(F.col("code"))[0].alias("bucket")).agg(F.count(F.lit(1)).alias("size"))


def counts(maps: DataFrame, codes: DataFrame, uid: str = "uid") -> DataFrame:
    """``(uid, bucket, n_played, n_unplayed)`` of the touched buckets (in the others all are unplayed)."""
    n = maps.groupBy(uid, "bucket").agg(F.sum(F.bit_count("bits")).alias("n_played"))
    return n.join(bucket_sizes(codes), "bucket").select(uid, "bucket", "n_played", (F.col("size") - F.col("n_played")).alias("n_unplayed"))


def is_played(pairs: DataFrame, maps: DataFrame, codes: DataFrame, uid: str = "uid", mid: str = "mid",
              out: str = "played") -> DataFrame:
    """``pairs`` with ``out``: NULL for an unknown or NULL item, else whether the bit is set."""
    bucket, word, bit = _place(F.col("_code"))
    j = (pairs.join(codes.select(F.col("label").alias(mid), F.col("code").alias("_code")), mid, "left")
         .withColumns({"_bucket": bucket, "_word": word})
         .join(maps.select(F.col(uid), F.col("bucket").alias("_bucket"), F.col("word").alias("_word"), F.col("bits").alias("_bits")),
               [uid, "_bucket", "_word"], "left"))
    found = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return j.select(*pairs.columns, F.when(F.col("_code").isNotNull(), found).alias(out))

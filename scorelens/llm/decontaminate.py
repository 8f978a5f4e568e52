"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased; a text is the set of its five-word
shingles.  An item of fewer words is one shingle, its whole sequence, and is looked for
anywhere in a document.  A document contains an item if it holds at least ``threshold`` of
the item's shingles.

1. Items have size classes (the power of two above their shingle count).  An item's
   sketch is its bottom-m MinHash: the m smallest shingle hashes, where m is the number
   of shingles that may be missing at that size, plus one.  By the pigeonhole principle a
   containing document hits the sketch, however long it is: no near miss is lost.
2. The index, one small row for each sketch hash, is broadcast in parts of at most
   ``part_bytes`` (counted first); every document meets every part, so documents are never
   shuffled, and a document too small for an item's size skips it.
3. Only candidates are joined with the items' shingles.  Of a document's hits on one item
   only the smallest shared sketch hash counts, so each pair is verified once: exact
   containment of the item's shingles as word sequences in the document.

Null and empty texts match nothing; repeated items (same id and text) count once, repeated
documents each give their rows; empty tables give no rows; other columns are ignored.
Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

SHINGLE = 5
THRESHOLD = 0.8
PART_BYTES = 32 << 20  # of one broadcast part of the index
ENTRY_BYTES = 64       # of an entry (hash, item) of the index as it is broadcast


def normal_text(text: Column) -> Column:
    """Lower-cased words (runs of letters and digits) joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingle_hashes(norm: Column, n: int = SHINGLE, shorter: list[int] = ()) -> Column:
    """Distinct 64-bit hashes of the ``n``-word shingles of a normalised text, and of its runs of
    the ``shorter`` numbers of words."""
    words = F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))

    def runs(wh, m):
        at = F.sequence(F.lit(0), F.greatest(F.size(wh) - m, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(m)]))

    def of(wh):
        return F.concat(*[runs(wh, m) for m in (n, *shorter)]) if shorter else runs(wh, n)

    # A one-element array binds the word hashes once for all shingles.
    made = F.get(F.transform(F.array(words), of), 0)
    return F.when(norm == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(made))


def shingle_texts(norm: Column, n: int = SHINGLE) -> Column:
    """The distinct shingles themselves."""
    words = F.split(norm, " ")
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, n)))))


def sketches(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
             threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """``(item, n_words, shingles, n_item, size_class, sketch)`` per distinct item with words."""
    base = (items.select(F.col(item_col).alias("item"), normal_text(F.col(text_col)).alias("norm"))
            .where("norm <> ''").distinct())
    base = base.select("item", F.size(F.split("norm", " ")).alias("n_words"),
                       shingle_texts(F.col("norm"), n).alias("shingles"),
                       F.sort_array(shingle_hashes(F.col("norm"), n)).alias("hashes"))
    n_item = F.size("shingles")
    need = F.ceil(n_item * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return base.select(
        "item", "n_words", "shingles", n_item.alias("n_item"), need.alias("need"),
        F.ceil(F.log2(n_item)).cast("int").alias("size_class"),
        F.slice("hashes", F.lit(1), n_item - need + 1).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD, n: int = SHINGLE,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id, item, n_shared, n_item, size_class, containment)``: one row per document row and
    item that it contains."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    prepare(docs.sparkSession)
    found = sketches(items, item_col, item_text, threshold, n).withColumn("no", F.monotonically_increasing_id())
    found = stage(found, "decontaminate_items")
    size = found.agg(F.sum(F.size("sketch")).alias("entries"), F.collect_set(
        F.when(F.col("n_words") < n, F.col("n_words"))).alias("short")).first()  # at most n - 1 lengths
    parts = max(1, math.ceil((size["entries"] or 0) * ENTRY_BYTES / part_bytes))
    text = docs.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("norm"))
    text = text.withColumn("hashes", shingle_hashes(F.col("norm"), n, sorted(size["short"])))
    each = text.select("id", "norm", "hashes", F.explode_outer("hashes").alias("h"))
    out = None
    for p in range(parts):
        mine = found.where(F.pmod(F.xxhash64("no"), F.lit(parts)) == p) if parts > 1 else found
        index = mine.select("no", "need", F.explode("sketch").alias("h"))
        # The check stands behind an outer explode, so that Spark keeps it out of the join's
        # condition: the join then runs in one generated loop with the explode of the hashes.
        hit = each.join(F.broadcast(index), "h")
        large = F.when(F.size("hashes") >= F.col("need"), F.col("no"))
        hit = hit.select("id", "norm", "hashes", "h", F.explode_outer(F.array(large)).alias("no")).where("no IS NOT NULL")
        # Only candidates meet the items' shingles; a pair is judged at its first common hash.
        hit = hit.join(mine.select("no", "item", "n_item", "need", "size_class", "sketch", "shingles"), "no")
        padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
        first = F.get(F.filter("sketch", lambda s: F.array_contains("hashes", s)), 0) == F.col("h")
        shared = F.size(F.filter("shingles", lambda s: F.contains(
            padded, F.concat(F.lit(" "), s, F.lit(" ")))))
        hit = (hit.select("id", "item", "n_item", "need", "size_class",
                          F.explode_outer(F.array(F.when(first, shared))).alias("n_shared"))
               .where("n_shared >= need").select("id", "item", "n_shared", "n_item", "size_class"))
        out = hit if out is None else out.unionByName(hit)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.  Rows are told
    apart by id and text, so a null or repeated id does not take other rows along."""
    keyed = docs.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    bad = contaminated(keyed, items, "_key", text_col, **kw).select(F.col("id").alias("_bad")).distinct()
    return keyed.join(bad, keyed["_key"].eqNullSafe(bad["_bad"]), "left_anti").select(*docs.columns)

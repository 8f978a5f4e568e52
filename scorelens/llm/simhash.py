"""SimHash near-duplicates: exact linking of 64-bit fingerprints within a bit radius.

1. Each text becomes a fingerprint (majority vote over the XXH64 of its word shingles);
   equal fingerprints form one class, counted before any shuffle.
2. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit
   blocks, so classes meet only in buckets of an equal block (no cross join).
3. Inside a bucket the fingerprints are sorted by population count and cut into tiles;
   tile pairs whose population counts differ by more than the radius are skipped, the
   others are compared exactly with exclusive-or and bit counts.
4. A bucket above ``max_bucket`` classes is cut again on the blocks of its other bits
   (the same argument), and what is still large becomes (tile, tile) work items, each of
   at most two tiles, spread over all tasks.  Nothing is dropped.
5. A work item emits a spanning forest of its links, not all pairs; the forests are
   joined by connected components.

Null or empty texts (no words) have fingerprint zero and are linked like any other;
repeated rows share a class; a null id never becomes a component id (a component of
null ids only has a null id); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_runs, prepare, stage
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 512
MAX_BUCKET = 4096
BITS = 64


def simhash64(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), len(words)
    xx = xxhash.xxh64_intdigest
    if k <= n:
        return xx(joined, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=k)
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = np.array([xx(joined[a:b], seed) for a, b in
                  zip(start[:k - n + 1].tolist(), end[n - 1:].tolist())], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded working memory for very long texts
        bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(h)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE, seed: int = SEED, keys: tuple[Column, ...] = ()) -> DataFrame:
    """``(id, fp)``: one row per row of ``docs``, ``fp`` as a signed 64-bit integer; the
    bigint columns ``keys`` come along as ``k0, k1, ...``."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = np.array([simhash64(t, n, seed) for t in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp.view(np.int64)), *[b[k] for k in names]],
                                             names=["id", "fp", *names])

    names = [f"k{i}" for i in range(len(keys))]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       *[k.alias(x) for k, x in zip(keys, names)]).mapInArrow(
        run, ", ".join([f"id {kind}", "fp bigint", *[f"{x} bigint" for x in names]]))


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i]), as pairs of fingerprints."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(fps[i]), int(fps[j])))
    return out


def tiled_links(fps: np.ndarray, pops: np.ndarray, radius: int, tile: int = TILE,
                side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links within ``radius`` bits among fingerprints, as a forest.  With ``side`` only
    pairs of different sides are compared."""
    order = np.argsort(pops, kind="stable")
    fps, pops = fps[order], pops[order]
    side = side[order] if side is not None else None
    u, left, right = fps.view(np.uint64), [], []
    cuts = list(range(0, len(fps), tile))
    for x in cuts:
        for y in cuts[x // tile:]:
            if pops[y] - pops[min(x + tile, len(fps)) - 1] > radius:
                break  # tiles are in order of population count: all later ones differ more
            near = np.bitwise_count(u[x:x + tile, None] ^ u[None, y:y + tile]) <= radius
            if side is not None:
                near &= side[x:x + tile, None] != side[None, y:y + tile]
            i, j = np.nonzero(near)
            keep = (i + x < j + y)
            left.append(i[keep] + x)
            right.append(j[keep] + y)
    if not left:
        return []
    return _forest(fps, np.concatenate(left), np.concatenate(right))


def _blocks(width: int, n: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``n`` blocks that cover ``width`` bits."""
    cuts = [round(i * width / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _block(value, shift: int, bits: int):
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE,
          max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(u, v)`` links between the distinct fingerprints ``fp`` of ``classes`` whose
    transitive closure equals that of all pairs within ``radius`` bits."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    fp = F.col("fp")
    level1 = _blocks(BITS, radius + 1)
    keyed = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("b"), _block(fp, s, w).alias("k"))
        for i, (s, w) in enumerate(level1)])).alias("x")).select("fp", "x.b", "x.k")
    sizes = keyed.groupBy("b", "k").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.where(F.col("n") > max_bucket).select("b", "k", F.lit(True).alias("big"))
    keyed = stage(keyed.join(big, ["b", "k"], "left"), "simhash_keyed")
    pop = F.bit_count("fp").cast("int").alias("pop")

    def small(frames):
        import pandas as pd
        for run in key_runs(frames, ["b", "k"]):
            if len(run) > 1:
                got = tiled_links(run["fp"].to_numpy(), run["pop"].to_numpy(), radius, tile)
                if got:
                    yield pd.DataFrame(got, columns=["u", "v"])

    near = (keyed.where("big is null").select("b", "k", "fp", pop).repartition("b", "k")
            .sortWithinPartitions("b", "k").mapInPandas(small, "u bigint, v bigint"))

    # Large buckets: the remaining bits, squeezed together, are cut into blocks again.
    hot = keyed.where("big")
    sub = []
    for i, (s, w) in enumerate(level1):
        low = _block(fp, 0, s) if s else F.lit(0).cast("bigint")
        high = F.shiftrightunsigned(fp, s + w) if s + w < BITS else F.lit(0).cast("bigint")
        rest = F.shiftleft(high, s).bitwiseOR(low)
        for j, (s2, w2) in enumerate(_blocks(BITS - w, radius + 1)):
            sub.append(F.when(F.col("b") == i, F.struct(
                F.lit(j).alias("b2"), _block(rest, s2, w2).alias("k2"))))
    hot = (hot.select("b", "k", "fp", pop, F.explode(F.filter(
        F.array(*sub), lambda x: x.isNotNull())).alias("x"))
        .select(F.xxhash64("b", "k", "x.b2", "x.k2").alias("bucket"), "fp", "pop"))
    hot = stage(hot, "simhash_hot")
    counts = hot.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("n"))
    tiles = counts.select("bucket", "pop", F.ceil(F.col("n") / tile).cast("int").alias("c"))
    spread = hot.join(tiles, ["bucket", "pop"]).select(
        "bucket", "pop", "fp",
        F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int").alias("slot"))
    each = tiles.select("bucket", "pop", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("slot"))
    a, b = each.toDF("bucket", "p1", "s1"), each.toDF("bucket", "p2", "s2")
    work = (a.join(b, "bucket")
            .where(F.col("p2").between(F.col("p1"), F.col("p1") + radius)
                   & ((F.col("p1") < F.col("p2")) | (F.col("s1") <= F.col("s2")))))
    work = stage(work.withColumn("w", F.xxhash64("bucket", "p1", "s1", "p2", "s2")), "simhash_work")
    first = spread.join(work.select("bucket", F.col("p1").alias("pop"), F.col("s1").alias("slot"), "w"),
                        ["bucket", "pop", "slot"]).select("w", "fp", "pop", F.lit(0).alias("side"))
    other = work.where("p1 <> p2 or s1 <> s2")
    second = spread.join(other.select("bucket", F.col("p2").alias("pop"), F.col("s2").alias("slot"), "w"),
                         ["bucket", "pop", "slot"]).select("w", "fp", "pop", F.lit(1).alias("side"))

    def paired(frames):
        import pandas as pd
        for run in key_runs(frames, ["w"]):
            side = run["side"].to_numpy()
            got = tiled_links(run["fp"].to_numpy(), run["pop"].to_numpy(), radius, tile,
                              side if side.any() else None)
            if got:
                yield pd.DataFrame(got, columns=["u", "v"])

    far = (first.unionByName(second).repartition("w").sortWithinPartitions("w")
           .mapInPandas(paired, "u bigint, v bigint"))
    return near.unionByName(far)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n: int = SHINGLE, seed: int = SEED, radius: int = RADIUS,
                       tile: int = TILE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(id, fp, component_id)`` per row: ``component_id`` is the smallest id reachable
    over links of at most ``radius`` differing bits, the row itself included."""
    return _rooted(docs, id_col, text_col, n, seed, radius, tile, max_bucket).select("id", "fp", "component_id")


def _rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
            seed: int = SEED, radius: int = RADIUS, tile: int = TILE, max_bucket: int = MAX_BUCKET,
            keys: tuple[Column, ...] = ()) -> DataFrame:
    """``simhash_components`` with the component itself, ``root``, and the columns ``keys``."""
    fps = stage(fingerprints(docs, id_col, text_col, n, seed, keys), "simhash_fp")
    classes = stage(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash_class")
    roots = components(links(classes, radius, tile, max_bucket))
    rooted = classes.join(roots, classes.fp == roots.u, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    lead = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(rooted.join(lead, "root").select("fp", "root", "component_id"), "simhash_named")
    return fps.join(named, "fp")


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns: rows that differ in any have other keys.  A hash
    skips nulls, so each column's null flag is hashed with it."""
    parts = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return tuple(F.xxhash64(F.lit(i), *parts) for i in range(2))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row of each component stays: the one with the smallest id (a null id only if no id
    of the component is known), and of several rows with it the smallest in the other columns.
    Components are told apart by themselves, not by their id: each component of null ids keeps
    a row, and so does each that a repeated id stands in.  All columns stay."""
    keyed = docs.withColumns(dict(zip(("_k0", "_k1"), _row_keys(docs))))
    found = _rooted(docs, id_col, keys=_row_keys(docs), **kw).where("id <=> component_id")
    # Rows with their component's id, repeated ones once; mostly one a component.
    first = stage(found.groupBy("root", "k0", "k1").agg(F.lit(1).alias("one")), "simhash_first")
    sizes = first.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k0", "k1")).alias("k"))
    single = sizes.where("n = 1").select(F.col("k.k0").alias("_k0"), F.col("k.k1").alias("_k1"))
    tied = first.join(sizes.where("n > 1").select("root"), "root", "left_semi").select(
        "root", F.col("k0").alias("_k0"), F.col("k1").alias("_k1"))
    rest = [c for c in docs.columns if c != id_col]
    won = (keyed.join(tied, ["_k0", "_k1"]).groupBy("root")
           .agg(F.min(F.struct(*rest, "_k0", "_k1")).alias("w")).select("w._k0", "w._k1"))
    heads = stage(single.unionByName(won), "simhash_heads")
    return keyed.join(heads, ["_k0", "_k1"], "left_semi").dropDuplicates(["_k0", "_k1"]).select(*docs.columns)

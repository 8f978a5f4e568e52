"""Repeated passages: sparse enhanced suffix arrays and their common-prefix interval trees.

A byte of a text is repeated if a string of ``length`` bytes that covers it also starts
anywhere else (another document or the same one); strings never cross documents.

1. Anchors.  In every ``length``-byte window the ``GRAM``-byte string with the smallest hash
   is its anchor (the leftmost of equals): equal windows have equal anchors at equal offsets.
   An anchor's context is the union of the windows that chose it, so every repeated window
   lies in two contexts with the same anchor string, and all others need not be compared.
2. Spark counts the contexts of each anchor string.  One context alone is unique; if all
   are equal they are repeated as a whole.  Only anchor strings with different contexts go
   on, each distinct context once.
3. For each of these the suffixes that start at the anchors are sorted, with their longest
   common prefixes: an enhanced suffix array.  A stack scan walks its interval tree.  In
   each interval (a common right extension and all its occurrences) the left extensions
   are sorted too; an interval of these whose members differ on the left, and that no
   deeper right interval holds whole, is a maximal repeat with all its occurrences.
4. A string with more than ``MAX_CONTEXTS`` distinct contexts (a passage that very many
   documents share) is split: the contexts' windows are hashed and counted in Spark, one
   row per window, so no task holds the group.  The result is the same.

Null and empty texts and those shorter than ``length`` have no repeats; repeated rows repeat
each other; an empty table gives no rows; other columns are ignored.  Rows are known by 96
bits, ``k`` (hash of id, its being null, and text) and ``t`` (another hash of the text), so null and
repeated ids are told apart by their texts; equal rows share a key and are fetched once.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_hashes, prepare, stage, window_hashes

LENGTH = 200
GRAM = 40
MAX_CONTEXTS = 16_384


def anchors(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(position, left, right, hash)`` of the anchors of one text; the context is
    ``[position - left, position + right)``."""
    n = len(b) - length + 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64)
    full = window_hashes(prefix_hashes(b), gram)
    low = (full >> np.uint64(32)).astype(np.uint32)
    pos = np.arange(len(low), dtype=np.int32)
    width, span = 1, length - gram + 1  # anchors a window may choose from
    while True:
        shift = min(width, span - width)
        if shift <= 0:
            break
        right = low[shift:] < low[:-shift]
        pos = np.where(right, pos[shift:], pos[:-shift])
        low = np.where(right, low[shift:], low[:-shift])
        width += shift
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    at = pos[first].astype(np.int64)
    return at, at - first, last + length - at, full[at]


def _common(keys: list[bytes]) -> np.ndarray:
    """Longest common prefix of each of the sorted keys with the one before (0 first)."""
    size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    width = int(size.max()) if len(keys) else 0
    out = np.zeros(len(keys), dtype=np.int64)
    if width:
        m = np.frombuffer(b"".join(k.ljust(width, b"\x00") for k in keys), dtype=np.uint8).reshape(-1, width)
        differ = m[1:] != m[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[1:] = np.minimum(at, np.minimum(size[1:], size[:-1]))
    return out


def intervals(lcp: list[int]):
    """``(depth, first, last)`` of the interval tree of a common-prefix array, by one stack
    scan; children come before their parents."""
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        here = lcp[i] if i < n else -1
        left = i - 1
        while stack and here < stack[-1][0]:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if not stack or here > stack[-1][0]:
            stack.append((here, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH):
    """Maximal repeats of at least ``length`` bytes around one anchor string, as ``(members,
    left, right)``: the contexts numbered ``members`` agree on ``left`` bytes before the
    anchor (``lefts`` are reversed) and ``right`` bytes from it on, and not all on more."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = _common([rights[i] for i in order])
    back = sorted(range(n), key=lefts.__getitem__)
    left_lcp = _common([lefts[i] for i in back])
    rank = np.empty(n, dtype=np.int64)
    rank[back] = np.arange(n)
    ranks = rank[order]            # left rank by right rank
    right_of = np.empty(n, dtype=np.int64)
    right_of[ranks] = np.arange(n)  # right rank by left rank
    longest_left = int(left_lcp.max()) if n else 0
    for depth, first, last in intervals(lcp.tolist()):
        if first == last or depth + longest_left < length:
            continue
        here = np.sort(ranks[first:last + 1])
        # Common left extension of neighbours: the least over the left ranks between them.
        common = np.zeros(len(here), dtype=np.int64)
        common[1:] = np.minimum.reduceat(left_lcp, here[:-1] + 1)[:len(here) - 1] if len(here) == n else [
            left_lcp[a + 1:b + 1].min() for a, b in zip(here[:-1].tolist(), here[1:].tolist())]
        if depth + common.max() < length:
            continue
        for left, a, z in intervals(common.tolist()):
            if a == z or left + depth < length:
                continue
            held = np.sort(right_of[here[a:z + 1]])
            if lcp[held[0] + 1:held[-1] + 1].min() > depth:
                continue  # a deeper right interval holds all of them
            yield [order[i] for i in held.tolist()], left, depth


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(k, t, pos, l, r, h, c)``: every anchor with the hash of its context."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            take = []
            for row, (text, t) in enumerate(zip(batch["text"].to_pylist(), batch["t"].to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                at, left, right, h = anchors(np.frombuffer(raw, dtype=np.uint8), length, gram)
                if not len(at):
                    continue
                digest = xxhash.xxh3_64_intdigest
                c = [digest(raw[a:b]) for a, b in zip((at - left).tolist(), (at + right).tolist())]
                take.append(np.full(len(at), row))
                for own, x in zip(cols, (np.full(len(at), t, dtype=np.int32), at.astype(np.int32), left.astype(np.int16),
                                         right.astype(np.int16), h.view(np.int64), np.array(c, dtype=np.uint64).view(np.int64))):
                    own.append(x)
            if take:
                yield pa.RecordBatch.from_arrays(
                    [batch["k"].take(pa.array(np.concatenate(take))), *[pa.array(np.concatenate(x)) for x in cols]],
                    names=["k", "t", "pos", "l", "r", "h", "c"])

    return docs.select("k", "t", "text").mapInArrow(run, "k bigint, t int, pos int, l smallint, r smallint, h bigint, c bigint")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, c, l, x)``: the bytes ``x`` of the wanted contexts, fetched from their texts."""
    lists = wanted.groupBy("k", "t").agg(F.collect_list(F.struct("h", "c", "pos", "l", "r")).alias("want"))
    found = docs.join(lists, ["k", "t"]).select("text", "want")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for text, want in zip(batch["text"].to_pylist(), batch["want"].to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["h"], w["c"], w["l"], raw[w["pos"] - w["l"]:w["pos"] + w["r"]]) for w in want]
            h, c, left, x = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(left, pa.int16()), pa.array(x, pa.binary())],
                names=["h", "c", "l", "x"])

    return found.mapInArrow(run, "h bigint, c bigint, l smallint, x binary")


def _groups(batches):
    """Lists of ``(c, l, x)`` of one ``h`` each, from batches sorted by ``h``."""
    key, held = None, []
    for batch in batches:
        for h, c, left, x in zip(*[batch[n].to_pylist() for n in ("h", "c", "l", "x")]):
            if h != key:
                if held:
                    yield key, held
                key, held = h, []
            held.append((c, left, x))
    if held:
        yield key, held


def _over_groups(contexts: DataFrame, length: int, rows_of, schema: str) -> DataFrame:
    """Rows that ``rows_of(h, group, repeats)`` makes of each anchor string's contexts and
    their maximal repeats."""
    def run(batches):
        import pyarrow as pa
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"bigint": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]
        rows: list[tuple] = []

        def made():
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

        for h, group in _groups(batches):
            lefts = [x[:left][::-1] for _, left, x in group]
            rights = [x[left:] for _, left, x in group]
            rows += rows_of(h, group, maximal_repeats(lefts, rights, length))
            if len(rows) > 20_000:
                yield made()
                rows = []
        yield made()

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def repeat_groups(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(h, c, part, l, r)``: maximal repeats by anchor string ``h``, numbered ``part``; one
    row per occurrence (a context ``c``), covering ``l`` bytes before its anchor and ``r`` from it."""
    def rows_of(h, group, repeats):
        return [(h, group[i][0], part, left, right)
                for part, (members, left, right) in enumerate(repeats) for i in members]

    return _over_groups(contexts, length, rows_of, "h bigint, c bigint, part int, l int, r int")


def repeat_covers(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(h, c, l, r)``: the union of all occurrences of maximal repeats in each context, a
    row per context that has any (each occurrence holds the anchor, so they overlap)."""
    def rows_of(h, group, repeats):
        most: dict[int, tuple[int, int]] = {}
        for members, left, right in repeats:
            for i in members:
                a, b = most.get(i, (0, 0))
                most[i] = max(a, left), max(b, right)
        return [(h, group[i][0], a, b) for i, (a, b) in most.items()]

    return _over_groups(contexts, length, rows_of, "h bigint, c bigint, l int, r int")


def _window_covers(contexts: DataFrame, length: int) -> DataFrame:
    """``(h, c, l, r)`` for anchor strings with very many contexts: windows counted in Spark."""
    def run(batches):
        import pyarrow as pa
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for h, c, left, x in zip(*[batch[n].to_pylist() for n in ("h", "c", "l", "x")]):
                rows += [(h, c, left - s, digest(x[s:s + length]) - (1 << 63)) for s in range(len(x) - length + 1)]
            cols = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["h", "c", "o", "w"])

    windows = stage(contexts.mapInArrow(run, "h bigint, c bigint, o int, w bigint"), "repeat_windows")
    twice = windows.groupBy("h", "o", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(twice, ["h", "o", "w"]).groupBy("h", "c").agg(
        F.max("o").alias("l"), (F.lit(length) - F.min("o")).alias("r"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS
                   ) -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: ``texts`` is ``(k, t, id, text, copies)`` per distinct row (null texts empty),
    ``spans`` ``(k, t, spans)`` with the repeated byte ranges ``(lo, hi)`` of each, overlapping."""
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("k"), F.hash(text).alias("t"))
    rows = stage(_anchor_rows(texts, length, gram), "repeat_anchors")
    by_h = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2"))
            .where("n > 1").select("h", (F.col("c1") != F.col("c2")).alias("mixed")))
    by_h = stage(by_h, "repeat_strings")  # a table, so that AQE can split a hot string's join
    shared = stage(rows.join(by_h, "h"), "repeat_shared")
    mixed = shared.where("mixed")
    first = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct("k", "t", "pos", "l", "r")).alias("at"))
    first = stage(first.select("h", "c", "n", "at.*"), "repeat_contexts")
    # A context that stands twice is repeated whole, whatever the others are: its rows need no
    # more than a semi join with a table, which AQE can split for a hot context.
    twice = mixed.join(first.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    same = shared.where("not mixed").select("k", "t", "pos", "l", "r").unionByName(twice.select("k", "t", "pos", "l", "r"))
    same = same.select("k", "t", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"))
    crowd = stage(first.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max_contexts).select("h"),
                  "repeat_crowd")
    wanted = first.select("h", "c", "k", "t", "pos", "l", "r")
    # One shuffle of the texts for both joins with them; equal rows are one, so no group gets
    # a context more than once and copies of a row do not meet in a task.
    placed = texts.groupBy("k", "t").agg(F.any_value(F.struct("id", "text")).alias("one"),
                                         F.count(F.lit(1)).alias("copies"))
    placed = placed.select("k", "t", "one.id", "one.text", "copies")
    covers = None
    if crowd.head(1):
        hot = _contexts(placed, wanted.join(crowd, "h", "left_semi"))
        covers = stage(_window_covers(stage(hot, "repeat_hot"), length), "repeat_hot_covers")
        wanted = wanted.join(crowd, "h", "left_anti")
    found = repeat_covers(_contexts(placed, wanted), length)
    found = found if covers is None else found.unionByName(covers)
    # The others stand once, so a context is a row.
    alone = first.where("n = 1").select("h", "c", "k", "t", "pos")
    some = found.withColumnsRenamed({"l": "cl", "r": "cr"}).join(alone, ["h", "c"]).select(
        "k", "t", (F.col("pos") - F.col("cl")).alias("lo"), (F.col("pos") + F.col("cr")).alias("hi"))
    spans = (same.unionByName(some).groupBy("k", "t")
             .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    return placed, spans


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(id, spans, n_bytes, n_removed, kept)`` per row: merged byte ranges ``(lo, hi)`` that
    are repeated, and the remaining bytes."""
    texts, spans = repeated_spans(docs, id_col, text_col, length, gram, max_contexts)
    both = texts.join(spans, ["k", "t"], "left").select("id", "text", "spans", "copies")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            all_spans, sizes, removed, kept = [], [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                cut = merged((x["lo"], x["hi"]) for x in found or ())
                edges = [0, *[x for pair in cut for x in pair], len(raw)]
                all_spans.append([{"lo": a, "hi": b} for a, b in cut])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in cut))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(all_spans, span), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()), batch["copies"]], names=["id", "spans", "n_bytes", "n_removed", "kept", "copies"])

    found = both.mapInArrow(run, f"id {kind}, spans array<struct<lo:int,hi:int>>, n_bytes bigint, n_removed bigint, "
                                 "kept binary, copies bigint")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return found.withColumn("_copy", each).drop("_copy", "copies")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Merged repeated ranges by a table of all windows (tests)."""
    seen: dict[bytes, int] = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    return [merged((i, i + length) for i in range(len(b) - length + 1) if seen[b[i:i + length]] > 1) for b in texts]

"""Document fingerprints by content-defined chunking.

A 64-bit gear hash rolls over the UTF-8 bytes.  Chunk ends are found by normalised
chunking: from ``MIN_CHUNK`` to ``AVG_CHUNK`` bytes a strict mask decides, from there to
``MAX_CHUNK`` a loose one, so lengths gather around the average; a chunk that meets neither
ends at ``MAX_CHUNK``.  An edit moves only the chunk ends near it.

The fingerprint is the set of chunk digests with their lengths, as text: ten hex digits
per distinct chunk (32-bit digest, 8-bit length), sorted.  Equal texts have equal
fingerprints; likeness is the length-weighted containment of one set in the other.

Null and empty texts have the empty fingerprint: contained in each other (1), and in
nothing else (0).  Repeated rows are each others' next documents; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prefix_hashes, prepare, span_hashes

MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 16, 64, 255
STRICT_BITS, LOOSE_BITS = 7, 5     # around log2(AVG_CHUNK)
GEAR_SEED = 0x5EED
GEAR = np.random.default_rng(GEAR_SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
PARTITION_ROWS = 20_000   # about so many documents to a range of ids
MAX_RANGES = 2048         # of which the driver knows the bounds; larger ranges are streamed alike


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """Gear hash after each byte, h = 2 h + GEAR[byte] modulo 2**64, by doubling windows."""
    h = GEAR[b]
    w = 1
    while w < 64 and w < len(h):
        g = h.copy()
        g[w:] += h[:-w] << np.uint64(w)
        h = g
        w *= 2
    return h


def chunk_ends(b: np.ndarray) -> np.ndarray:
    n = len(b)
    h = gear_hashes(b)
    loose = np.flatnonzero((h >> np.uint64(64 - LOOSE_BITS)) == 0)
    strict = loose[(h[loose] >> np.uint64(64 - STRICT_BITS)) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        # An end after byte i makes the chunk [at, i + 1).
        i = bisect_left(strict, at + MIN_CHUNK - 1)
        if i < len(strict) and strict[i] < at + AVG_CHUNK:
            at = strict[i] + 1
        else:
            i = bisect_left(loose, at + AVG_CHUNK)
            at = min(loose[i] + 1 if i < len(loose) else n, at + MAX_CHUNK, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return np.array(ends, dtype=np.int64)


def chunks(text: str) -> np.ndarray:
    """Sorted distinct chunks as ``digest << 8 | length``."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    end = chunk_ends(b)
    start = np.concatenate([[0], end[:-1]])
    digest = span_hashes(prefix_hashes(b), start, end) >> np.uint64(32)
    return np.unique((digest << np.uint64(8)) | (end - start).astype(np.uint64))


def as_text(c: np.ndarray) -> str:
    return "".join(f"{x:010x}" for x in c.tolist())


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i:i + 10], 16) for i in range(0, len(fingerprint), 10)], dtype=np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the length of ``a``'s chunks that ``b`` has too."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    length = (a & np.uint64(255)).astype(np.int64)
    return float(length[np.isin(a, b, assume_unique=True)].sum() / length.sum())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` per row."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            made = [as_text(chunks(t or "")) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(made, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``; the next document has the next smaller id (after the smallest, the
    largest; ties by text, null ids last).

    Ids are cut into ranges of about ``partition_rows`` documents; the head of each range
    travels along to the range before it, so every task sees its documents' successors and
    texts are shuffled once.  The driver sees one id per range, of MAX_RANGES at most."""
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, lo, hi = base.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    ranges = min(max(1, math.ceil(n / partition_rows)), MAX_RANGES)
    cuts = []
    if ranges > 1 and lo is not None:
        at = base.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
        cuts = sorted(set(at), reverse=True)
    kind = docs.schema[id_col].dataType
    # Range 0 has the largest ids; an id equal to a cut is in the range above it; null ids are last.
    number = F.lit(len(cuts)) if not cuts else F.coalesce(
        F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: F.col("id") < c)), F.lit(len(cuts)))
    number = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(number)
    placed = base.withColumn("r", number.cast("int"))
    # A range's head is the first of its rows: largest id, then smallest text.
    tops = {r["r"]: r["id"] for r in placed.groupBy("r").agg(F.max("id").alias("id")).collect()}
    order = sorted(tops)
    # The range before the first is the last: at most one row per range, at most MAX_RANGES.
    heads = spark.createDataFrame([(r, tops[r], order[i - 1]) for i, r in enumerate(order)],
                                  T.StructType([T.StructField("r", T.IntegerType()), T.StructField("top", kind),
                                                T.StructField("before", T.IntegerType())]))
    placed = placed.join(F.broadcast(heads), "r", "left")
    guest = F.when(F.col("id").eqNullSafe(F.col("top")), F.col("before"))
    both = F.filter(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("guest")),
                            F.struct(guest.alias("r"), F.lit(1).alias("guest"))), lambda x: x["r"].isNotNull())
    sent = placed.select("id", "text", F.explode(both).alias("x")).select("id", "text", "x.r", "x.guest")
    parts = max(len(order), 1)
    sent = sent.repartition(parts, "r").sortWithinPartitions(
        "r", "guest", F.col("id").desc_nulls_last(), "text")

    def run(batches):
        import pyarrow as pa
        held = None  # (range, id, text, chunks) of the row before

        def compared(a, b):
            mine, changed = a[3], edited(a[2], b[2])
            new = chunks(changed)
            return (a[1], len(a[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    as_text(mine), as_text(new), containment(mine, new), containment(mine, b[3]))

        for batch in batches:
            rows = []
            for key, text, r, is_guest in zip(*[batch[c].to_pylist() for c in ("id", "text", "r", "guest")]):
                if held is not None and held[0] != r:
                    held = None
                if is_guest:
                    if held is not None:  # only the first guest follows the range's last row
                        rows.append(compared(held, (r, key, text, chunks(text))))
                        held = None
                    continue
                now = (r, key, text, chunks(text))
                if held is not None:
                    rows.append(compared(held, now))
                held = now
            made = list(zip(*rows)) or [()] * 7
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(),
                     pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(made, kinds)],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next"])

    return sent.mapInArrow(run, f"id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")

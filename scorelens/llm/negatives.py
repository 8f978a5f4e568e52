"""Hard-negative mining: exact integer scores by a residue-number-system matrix product.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Where ``vec_id`` is divisible by ``SHIFT_EVERY``, label becomes ``(label + 1) % LABELS``.
Components become ``floor(256 x)``; a score is the integer inner product of two rows.
Anchors are the rows whose id is divisible by ``ANCHOR_EVERY`` (a stated query set); an anchor's
positives are its first ``positives`` other rows of the same label, highest score first, ties by smaller id.
For each anchor and positive the first ``negatives`` rows of other labels are returned whose
score is from 30 to 90 per cent of the positive's.

1. Products.  The components are reduced modulo several primes below ``2**10`` to signed
   residues, multiplied as float32 matrices modulo each prime, and the exact signed scores
   come back by Chinese remaindering.  Every float32 sum stays below ``2**24``: dimensions go in
   blocks of ``DIMS``.  As many primes are taken as the largest possible score needs.
2. Blocks.  Anchors are packed in batches of at most ``BATCH_BYTES`` of components, the only data
   that is broadcast.  For each batch every task holds blocks of ``ROWS`` rows against it and
   hands on each anchor's best rows of the block; a rank per anchor picks the best of all.
3. A second pass knows each positive's score, so the same product gives the window's rows; per
   block, anchor and positive only the first ``negatives`` leave the task.

Vectors of unequal length are compared over the shorter one's components.  Rows that are
equal to another row are rows of their own: copies of an anchor's row are among its
positives, a repeated anchor repeats its output.  A row without an id is no anchor and comes
after the others in ties.  Empty tables give no rows; other columns are ignored.  Scores that
could pass 62 bits raise ``OverflowError``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage

ANCHOR_EVERY = 100
SHIFT_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256
DIMS = 64           # of one float32 product
ROWS = 32_768       # of a block of rows
ANCHORS = 64        # that a task multiplies at a time
BATCH_BYTES = 16 << 20
PAIRS = 1 << 27     # products that a task is planned for


def primes(bound: int) -> list[int]:
    """The largest primes of which a signed residue's square, ``DIMS`` times, stays below
    ``2**24``, as many as tell all numbers from ``-bound`` to ``bound`` apart."""
    out: list[int] = []
    product, n = 1, 2 * int(((1 << 24) // DIMS) ** 0.5) + 1
    while product <= 2 * bound:
        if DIMS * (n // 2) ** 2 < 1 << 24 and all(n % q for q in range(2, int(n ** 0.5) + 1)):
            out.append(n)
            product *= n
        n -= 2
    if product >= 1 << 62:
        raise OverflowError(f"scores up to {bound} do not fit into 62 bits")
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Signed residues of an integer matrix modulo ``p`` as float32."""
    half = p // 2
    return ((x + half) % p - half).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact: float32 products modulo each prime, joined by
    Chinese remaindering (mixed radix), signed."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        r = np.zeros((len(a), len(b)), dtype=np.int64)
        for d in range(0, a.shape[1], DIMS):
            part = residues(a[:, d:d + DIMS], p) @ residues(b[:, d:d + DIMS], p).T
            r += part.astype(np.int32)
        # The digit of this prime: what the digits so far leave, over the primes so far.
        weight = 1
        for q, x in zip(moduli[:i], digits):
            r -= x * (weight % p)
            weight *= q
        r %= p
        digits.append(r * pow(weight, -1, p) % p)
    out, weight = 0, 1
    for p, x in zip(moduli, digits):
        out += x * weight
        weight *= p
    return np.where(out > weight // 2, out - weight, out)


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(row, id, label, vec)`` of the rows that take part, integers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col(label_col).cast("bigint")
    label = F.when(F.col(id_col) % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    kept = df.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(good)
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("bigint"))
    return kept.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"),
                       whole.alias("vec")).withColumn("row", F.monotonically_increasing_id())


def _matrix(lists, width: int) -> np.ndarray:
    """The rows of an Arrow list column as a matrix: cut or filled with zeros to ``width``."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(lists.offsets.to_numpy())
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), dtype=np.int64)
    at = 0
    for i, n in enumerate(size.tolist()):
        out[i, :min(n, width)] = flat[at:at + min(n, width)]
        at += n
    return out


def _blocks(batches, width: int):
    """``(ids, id is null, labels, rows, matrix)`` of up to ``ROWS`` rows, by id (nulls last)."""
    import pyarrow as pa

    held, n = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        missing = t["id"].is_null().to_numpy()
        ids = t["id"].fill_null(0).to_numpy().astype(np.int64)
        order = np.lexsort((ids, missing))
        m = _matrix(t["vec"].chunk(0), width)
        return ids[order], missing[order], t["label"].to_numpy()[order], t["row"].to_numpy()[order], m[order]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def _search(rows: DataFrame, sent, width: int, moduli: list[int], choose, names: list[str]) -> DataFrame:
    """Rows that ``choose(anchor number, labels equal, is itself, scores)`` picks, in each block
    for each anchor of the broadcast batch, with their id and score; ``names`` follow."""
    def run(batches):
        import pyarrow as pa
        anchors = sent.value
        for ids, missing, labels, own, m in _blocks(batches, width):
            parts = []
            for a in range(0, len(anchors["row"]), ANCHORS):
                scores = products(anchors["vec"][a:a + ANCHORS], m, moduli)
                for i, s in enumerate(scores, a):
                    same = labels == anchors["label"][i]
                    for at, *more in choose(anchors, i, same, own == anchors["row"][i], s):
                        parts.append((ids[at], missing[at], s[at],
                                      *[np.full(len(at), x, dtype=np.int64) for x in more]))
            if parts:
                got, null, *rest = [np.concatenate(x) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(got, mask=null), *[pa.array(x) for x in rest]],
                                                 names=["id", "score", *names])

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in ["id", "score", *names]))


def _first(s: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among ``able``, ties by place."""
    at = np.flatnonzero(able)
    if len(at) > 4 * k:  # all that reach the k-th score
        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-s[at], kind="stable")[:k]]


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    spark = prepare(df.sparkSession)
    rows = stage(vectors(df, id_col, vector_col, label_col), "negative_rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"),
                    F.max(F.array_max(F.transform("vec", lambda c: F.abs(c)))).alias("most"),
                    F.count_if(F.col("id") % ANCHOR_EVERY == 0).alias("anchors")).first()
    width = max(size["width"] or 0, 1)
    bound = width * (size["most"] or 0) ** 2
    moduli = primes(max(bound, 1))
    per_batch = max(1, batch_bytes // (8 * width))
    n_batches = -(-size["anchors"] // per_batch)
    parts = max(min(spark.sparkContext.defaultParallelism, -(-size["n"] // 2048)),
                -(-size["n"] * min(size["anchors"], per_batch) // PAIRS), 1)
    batch_of = F.pmod(F.xxhash64("row"), F.lit(max(n_batches, 1)))
    anchors = stage(rows.where(F.col("id") % ANCHOR_EVERY == 0).withColumn("batch", batch_of), "negative_anchors")
    dealt = rows.repartition(parts)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    out = None
    for b in range(n_batches):
        own = anchors.where(F.col("batch") == b).toArrow().combine_chunks()  # about batch_bytes
        if not own.num_rows:
            continue
        batch = {"row": own["row"].to_numpy(), "label": own["label"].to_numpy(), "vec": _matrix(own["vec"].chunk(0), width)}
        sent = spark.sparkContext.broadcast(batch)

        def nearest(_, i, same, itself, s):
            yield _first(s, same & ~itself, positives), i

        found = _search(dealt, sent, width, moduli, nearest, ["anchor"])
        k = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
        best = stage(found.withColumn("k", k).where(F.col("k") <= positives), "negative_positives").orderBy("anchor", "k")
        good = best.toArrow()  # at most ``positives`` rows for each of the batch's anchors
        at = good["anchor"].to_numpy()
        wanted = spark.sparkContext.broadcast(batch | {
            "at": np.searchsorted(at, np.arange(len(batch["row"]) + 1)), "score": good["score"].to_numpy(),
            "k": good["k"].to_numpy()})

        def window(known, i, same, _, s):
            for j in range(known["at"][i], known["at"][i + 1]):
                most = int(known["score"][j])
                lo, hi = -(-LOW * most // 100), HIGH * most // 100
                yield _first(s, ~same & (s >= lo) & (s <= hi), negatives), i, known["k"][j]

        found = _search(dealt, wanted, width, moduli, window, ["anchor", "k"])
        rank = F.row_number().over(Window.partitionBy("anchor", "k").orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(own["id"].to_pylist())], "anchor bigint, anchor_id bigint")
        best = best.select("anchor", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = found.join(best, ["anchor", "k"]).join(ids, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        part = stage(part, "negative_found")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    return out


def brute_force(rows: list[tuple], positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple]:
    """The result's rows from ``(id, vector, label)`` by plain loops (tests)."""
    import math

    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = math.fmod(label + 1, LABELS) if i is not None and i % SHIFT_EVERY == 0 else label
            good.append((i, [math.floor(SCALE * x) for x in v], int(label)))

    def ranked(a, others):
        last = (float("inf"),)
        return sorted(((-sum(x * y for x, y in zip(a[1], o[1])), last if o[0] is None else (o[0],), o[0]) for o in others),
                      key=lambda x: x[:2])

    out = []
    for n, a in enumerate(good):
        if a[0] is None or a[0] % ANCHOR_EVERY:
            continue
        near = ranked(a, [o for m, o in enumerate(good) if m != n and o[2] == a[2]])[:positives]
        far = ranked(a, [o for o in good if o[2] != a[2]])
        for p in near:
            hits = [f for f in far if LOW * -p[0] <= 100 * -f[0] <= HIGH * -p[0]][:negatives]
            out += [(a[0], p[2], k, f[2], -p[0], -f[0]) for k, f in enumerate(hits, 1)]
    return out

"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target texts and one of the whole corpus, are matched: same
tokens, vocabulary and smoothing, and the background counts are scaled to the target's
number of tokens (all documents are counted; none is sampled away).  A document's score is
the mean over its tokens of ``log2 P_background - log2 P_target``: below zero for texts that
are likelier in the target.

* Tokens are runs of letters and digits and runs of other marks, A-Z lower-cased.  The
  shared vocabulary holds the tokens that occur at least ``LEAST`` times in the target or in
  the corpus, whatever the size of either; the others are one unknown token.
* Both models have counts of their own for the same pairs, those that occur as often in the
  target or in the corpus; the mass of the others backs off to the single tokens, so each model sums to one:
  ``P(w|v) = (c(v, w) + (MU + r(v)) P(w)) / (c(v) + MU)``, ``r(v)`` being the count of the
  dropped pairs of ``v``.  After an unknown token it is ``P(w)``.

The counts grow with the corpus, so they are a table and never leave Spark.  Every pair of every
text of both sides is counted: tasks sum up some ``FLUSH`` tokens each, and their sums go to buckets
as sorted keys packed by their differences.  The keys are counted in ``PARTS`` ranges, one after the
other, so the texts are read once for each and must not change meanwhile.  A bitmap of the kept pairs' keys
(``FILTER_BITS``, 8 MB at any size) spares the table questions about others.  It only lets too
much through, and the table decides.

To score, documents are dealt to blocks of about ``BLOCK_BYTES`` of text; each block asks the
table for the distinct tokens and pairs that it holds, and a task holds the texts and counts
of one block.  A frequent pair is asked for once in a block, not once in a document.  Questions
are sorted keys, packed by their differences and dealt with the table to buckets of about
``BUCKET_KEYS`` keys; an answer has the counts in the order of the question, without the keys.

Null and empty texts have no tokens and are scored by their end alone; null labels and ids
select nothing; without target texts the target's model is uniform; repeated rows count and
score alike; a text longer than a block is a block of its own; an empty table gives no rows;
other columns are kept, but for those named like an added one (``ADDED``).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.sinks import delete_path, write_table
from .common import drop_staged, mix64, prefix_hashes, prepare, span_hashes, stage_and_free

ADDED = ("n_tokens", "ce_target", "ce_background", "ce_difference")
LEAST = 2        # occurrences, in the target or in the corpus, of a token or pair with a count
PARTS = 2        # ranges of the keys, counted one after the other: the disk holds the sums of one
BUCKET_BYTES = 8 << 20  # text for whose keys there is one bucket of sums (1024 buckets at least)
ALPHA = 1.0      # added to each single token's count
MU = 8.0         # weight of the single-token model in a pair's estimate
FLUSH = 2_000_000  # tokens that a task counts before it hands on its sums; sums that it adds up at once
BLOCK_BYTES = 16 << 20  # text scored with one set of counts
BUCKET_KEYS = 1 << 18   # keys of the table that a task holds to answer
CHUNK_KEYS = 8192       # keys in one row of a question
FILTER_BITS = 1 << 26   # bitmap of the kept pairs
BITMAP_BITS = 32768     # bits in a row of Spark's bitmap functions (fixed value)
# Keys of the start and end of a text and of the row that counts all tokens.
START, END, ALL = (-(1 << 63) + i for i in range(3))
NONE = -(1 << 63) + 3  # stands before single tokens, in packed sums

# Byte classes: 0 white space and controls, 1 letters, digits and all of UTF-8's upper bytes, 2 marks.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[:33] = 0
_KIND[127:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_ODD = np.uint64(0xD6E8FEB86659FD93)


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens, in order."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    kind = _KIND[b]
    edge = np.concatenate([[True], kind[1:] != kind[:-1], [True]])
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0
    return span_hashes(prefix_hashes(b), at[:-1][keep], at[1:][keep]).view(np.int64)


def sequence(text: str | None) -> np.ndarray:
    """Token hashes between the marks of start and end."""
    return np.concatenate([[START], token_hashes(text), [END]])


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v.view(np.uint64) * _ODD + w.view(np.uint64)).view(np.int64)


def _passed(pairs: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = pairs & (FILTER_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, set at the keys' low bits: at most 2,048 rows of 4 KB come to the driver."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = (pairs.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), dtype=np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _part(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which keys are in this one of so many equal ranges."""
    return ((keys >> 32) + (1 << 31)) * parts >> 32 == part


def _runs_of(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values in a sorted array begin, and its length."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[:len(x)]), [len(x)]])


def _marks(side: int, shift: int, *n: int) -> tuple:
    """A row of packed sums of START, END and ALL, which are in the first part."""
    return START >> shift, side, 3, pack_keys(np.array([START, END, ALL])), None, pack_counts([np.array(n)])


def _sums(texts: DataFrame, side: int, part: int, parts: int, shift: int) -> DataFrame:
    """Packed sums per ``FLUSH`` tokens of the tokens (``NONE`` before) and of the pairs of one part of the
    keys: a row has the ``n`` keys of a bucket, the token before each and the counts."""
    def made(held):
        import pyarrow as pa
        seq = np.concatenate(held)
        v, w = seq[:-1], seq[1:]
        pairs = pair_keys(v, w)
        use = _part(pairs, part, parts) & (v != END)
        pairs, v = pairs[use], v[use]
        order = np.argsort(pairs)
        rows = [_marks(side, shift, 0, 0, len(seq) - 2 * len(held))] if part == 0 else []
        for x, before in ((np.sort(seq[_part(seq, part, parts)]), None), (pairs[order], v[order])):
            first = _runs_of(x)
            keys, n = x[first[:-1]], np.diff(first)
            before = None if before is None else before[first[:-1]]
            cuts = _runs_of(keys >> shift).tolist()
            rows += [(int(keys[i] >> shift), side, j - i, pack_keys(keys[i:j]), None if before is None else before[i:j].tobytes(), pack_counts([n[i:j]]))
                     for i, j in zip(cuts[:-1], cuts[1:])]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["bucket", "side", "n", "keys", "before", "counts"]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i:i + 1000]), kinds)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                held.append(sequence(text))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    return texts.mapInArrow(run, "bucket bigint, side int, n bigint, keys binary, before binary, counts binary")


def _kept(sums: DataFrame, least: int) -> DataFrame:
    """``(key, ctx, n0, n1)`` of the tokens (no ``ctx``) and pairs with ``least`` occurrences on a side, and of the marks.
    Whole buckets are summed, together until they hold about ``FLUSH`` sums."""
    def summed(held):
        import pyarrow as pa
        key, ctx, side, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, ctx, side, n = key[order], ctx[order], side[order], n[order]
        first = _runs_of(key)[:-1]
        key, ctx = key[first], ctx[first]
        n0, n1 = (np.add.reduceat(np.where(side == k, n, 0), first) for k in (0, 1))
        token = ctx == NONE
        use = (n0 >= least) | (n1 >= least) | (token & np.isin(key, [START, END, ALL]))
        return pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(ctx[use], mask=token[use]), pa.array(n0[use]), pa.array(n1[use])],
                                          names=["key", "ctx", "n0", "n1"])

    def run(batches):
        bucket, held, size = None, [], 0
        for (at,), rows in _runs(batches, "bucket"):
            if at != bucket and size >= FLUSH:
                yield summed(held)
                held, size = [], 0
            bucket = at
            for side, n, keys, before, counts in zip(*[rows[c].to_pylist() for c in ("side", "n", "keys", "before", "counts")]):
                before = np.full(n, NONE) if before is None else np.frombuffer(before, dtype=np.int64)
                held.append((unpack_keys(keys, n), before, np.full(n, side, dtype=np.int8), unpack_counts(counts, n, 1)[0]))
                size += n
        if held:
            yield summed(held)

    return sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key bigint, ctx bigint, n0 bigint, n1 bigint")


@dataclass
class Model:
    bits: object             # broadcast bitmap of the pairs' keys
    counts: DataFrame        # key, n0, n1 (target, corpus) and for tokens k0, k1: their kept pairs
    n_vocab: int
    unknown: tuple           # of the target and the corpus: occurrences outside the vocabulary
    mass: tuple              # tokens and ends
    scale: tuple             # corpus counts are matched to the target's tokens
    shift: int               # a key's bucket is the key shifted right by so many bits


def fit(target: DataFrame, whole: DataFrame, text_col: str = "text", least: int = LEAST, parts: int = PARTS) -> Model:
    """Counts of both sides, written once; a few totals come to the driver.  What is staged besides is deleted."""
    spark = prepare(whole.sparkSession)
    target, whole = (x.select(F.col(text_col).cast("string").alias("text")) for x in (target, whole))
    # The target is written first: the shuffle of whole texts that finds it is freed before the counts'.
    target = stage_and_free(target, "lm_target")
    mark, single = F.col("key").isin(START, END, ALL), F.col("ctx").isNull()
    size = sum(x.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for x in (target, whole))
    shift = 64 - max(10, (size // BUCKET_BYTES).bit_length())
    made = []
    for part in range(parts):
        sums = _sums(whole, 1, part, parts, shift).union(_sums(target, 0, part, parts, shift))
        made.append(stage_and_free(_kept(sums if part else sums.union(spark.createDataFrame([_marks(0, shift, 0, 0, 0)], sums.schema)), least), "lm_kept"))
    kept = functools.reduce(DataFrame.union, made)
    bits = spark.sparkContext.broadcast(_bitmap(kept.where(~single)))
    single = kept.where(F.col("ctx").isNull()).select("key", "n0", "n1")
    pairs = kept.where(F.col("ctx").isNotNull())
    after = pairs.groupBy(F.col("ctx").alias("key")).agg(F.sum("n0").alias("k0"), F.sum("n1").alias("k1"))
    counts = stage_and_free(single.join(after, "key", "left").unionByName(
        pairs.select("key", "n0", "n1"), allowMissingColumns=True), "lm_counts")
    own = [F.sum(F.when(~mark, F.col(c))) for c in ("n0", "n1")]
    whole_side = [F.sum(F.when(F.col("key") == m, F.col(c))) for m in (ALL, END) for c in ("n0", "n1")]
    n_vocab, *sums = [x or 0 for x in single.agg(F.count_if(~mark), *own, *whole_side).first()]
    vocab, total, ends = sums[:2], sums[2:4], sums[4:]
    drop_staged(target, *made)
    return Model(bits, counts, n_vocab, tuple(total[k] - vocab[k] for k in (0, 1)), tuple(total[k] + ends[k] for k in (0, 1)),
                 (1.0, total[0] / total[1] if total[1] else 0.0), 64 - max(6, (counts.count() // BUCKET_KEYS).bit_length()))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort is many times faster here than the hash table of ``np.unique``)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[:len(x)]]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether it is there.  Looked for in
    order, so that neighbours share the cache."""
    order = np.argsort(wanted)
    inorder = wanted[order]
    place = np.minimum(np.searchsorted(keys, inorder), len(keys) - 1)
    at, known = np.empty(len(wanted), dtype=np.int64), np.empty(len(wanted), dtype=bool)
    at[order], known[order] = place, keys[place] == inorder
    return at, known


def cross_entropies(seqs: list, keys: np.ndarray, n: np.ndarray, kept: np.ndarray, n_vocab: int,
                    unknown, mass, scale) -> list[tuple[float, float]]:
    """Bits per token of each sequence under the target and the background model, from the
    counts ``n`` of the sorted ``keys`` (two rows, one a model) and those of a token's kept pairs."""
    seq = np.concatenate(seqs)
    ends = np.cumsum([len(x) for x in seqs])
    token, known = _find(keys, seq)
    pair, is_pair = _find(keys, pair_keys(seq[:-1], seq[1:]))
    logs = []
    for k in range(2):
        c = np.where(known, n[k][token], unknown[k]) * scale[k]
        single = (c[1:] + ALPHA) / (mass[k] * scale[k] + ALPHA * (n_vocab + 2))
        c, rest = c[:-1], np.maximum(c - kept[k][token] * scale[k], 0.0)[:-1]
        own = np.where(is_pair, n[k][pair], 0) * scale[k]
        p = np.where(known[:-1], (own + (MU + rest) * single) / (c + MU), single)
        logs.append(np.log2(p))
    # Between two sequences stands a pair that is in none.
    return [tuple(float(-x[i:j - 1].mean()) for x in logs) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _width(x: np.ndarray) -> int:
    return (int(x.max()).bit_length() + 7) // 8 if len(x) else 0


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys, at least one: the first, then the differences in as many bytes as the largest takes."""
    d = np.diff(keys.view(np.uint64))
    return keys[:1].astype("<i8").tobytes() + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_width(d)].tobytes()


def unpack_keys(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n > 1:
        body = np.frombuffer(packed, dtype=np.uint8, offset=8).reshape(n - 1, -1)
        out[1:, :body.shape[1]] = body
    d = out.view("<u8").reshape(-1)
    d[0] = np.frombuffer(packed, dtype="<u8", count=1)[0]
    return np.cumsum(d, dtype=np.uint64).view(np.int64)


def pack_counts(counts) -> bytes:
    """Rows of counts >= 0, each as its width and its bytes by place (the high ones are mostly zero)."""
    out = []
    for x in counts:
        w = _width(x)
        out += [bytes([w]), x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes()]
    return b"".join(out)


def unpack_counts(packed: bytes, n: int, rows: int = 4) -> np.ndarray:
    out, at = np.zeros((rows, n, 8), dtype=np.uint8), 0
    for i in range(rows):
        w = packed[at]
        out[i, :, :w] = np.frombuffer(packed, dtype=np.uint8, count=w * n, offset=at + 1).reshape(w, n).T
        at += 1 + w * n
    return out.view("<i8").reshape(rows, n)


def _wanted(seqs: list, bits: np.ndarray) -> np.ndarray:
    """The sorted distinct keys of token sequences that may have counts."""
    held, size = [], 0
    for seq in seqs:
        pairs = pair_keys(seq[:-1], seq[1:])
        held += [seq, pairs[_passed(pairs, bits)]]
        size += len(seq)
        if size >= FLUSH:
            held, size = [_distinct(np.concatenate(held))], 0
    return _distinct(np.concatenate(held))


def _asked(batches, bits, text_bytes: int, shift: int):
    """The rows with their ``block``, runs of rows of one task with about as many bytes of text,
    and behind each block's rows what it asks: ``n`` keys of a bucket, from place ``at`` on."""
    import pyarrow as pa

    def questions():
        keys = _wanted(seqs, bits.value)
        bucket = keys >> shift
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, np.arange(0, len(keys), CHUNK_KEYS), [len(keys)]]))
        at, to = cuts[:-1], cuts[1:]
        packed = [pack_keys(keys[i:j]) for i, j in zip(at.tolist(), to.tolist())]
        none = [pa.nulls(len(at), k) for k in kinds]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(bucket[at]), pa.array(at), pa.array(to - at),
                                           pa.array(packed, pa.binary()), *none], names=names)

    block, size, seqs = TaskContext.get().partitionId() << 32, 0, []
    for b in batches:
        kinds, names = [b["text"].type, b["own"].type], ["block", "bucket", "at", "n", "asked", "text", "own"]
        blocks, asks = [], []
        for n, text in zip(b["n_bytes"].to_pylist(), b["text"].to_pylist()):
            if size and size + n > text_bytes:
                asks.append(questions())
                block, size, seqs = block + 1, 0, []
            size += n
            blocks.append(block)
            seqs.append(sequence(text))
        none = [pa.nulls(len(blocks), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *none, b["text"], b["own"]], names=names)
        yield from asks
    if seqs:
        yield questions()


def _runs(batches, *cols):
    """``(key, slice)`` for each run of equal ``cols`` in the sorted batches."""
    for b in batches:
        if len(b):
            at = np.stack([b[c].to_numpy() for c in cols])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield tuple(at[:, i].tolist()), b.slice(i, j - i)


def _answers(batches):
    """``(block, at, n, answer)`` of a bucket's questions; its counts (block -1) come first."""
    import pyarrow as pa
    cols, bucket, held, table = ("key", "n0", "n1", "k0", "k1"), None, [], None
    for (at, block), part in _runs(batches, "bucket", "block"):
        if at != bucket:
            bucket, held, table = at, [], None
        if block < 0:
            held.append([part[c].fill_null(0).to_numpy(zero_copy_only=False) for c in cols])
            continue
        if table is None:
            table = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(1, dtype=np.int64)] * 5
            # A known key's first count is sent as one more, so zero tells an unknown key.
            order, known, held = np.argsort(table[0]), int(bool(held)), []
            table = [x[order] for x in table]
        made = []
        for packed, n in zip(part["asked"].to_pylist(), part["n"].to_pylist()):
            keys = unpack_keys(packed, n)
            i = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
            hit = (table[0][i] == keys) * known
            made.append(pack_counts([hit * (table[1][i] + 1), *[hit * x[i] for x in table[2:]]]))
        yield pa.RecordBatch.from_arrays([part["block"], part["at"], part["n"], pa.array(made, pa.binary())], names=["block", "at", "n", "answer"])


def score(docs: DataFrame, model: Model, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_tokens, ce_target, ce_background, ce_difference`` (bits per token)."""
    spark = prepare(docs.sparkSession)
    own = [c for c in docs.columns if c not in ADDED]
    # A text of type string is carried once, the other columns in a struct: their names cannot clash.
    carried = [c for c in own if c != text_col or not isinstance(docs.schema[c].dataType, T.StringType)]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"), row.alias("own"))
    bits, shift = model.bits, model.shift
    long = T.LongType()
    row_type = T.StructField("own", given.schema["own"].dataType, True)
    kinds = T.StructType([*[T.StructField(c, long) for c in ("block", "bucket", "at", "n")], T.StructField("asked", T.BinaryType()),
                          T.StructField("text", T.StringType()), row_type])
    # Questions are a folder beside the texts', deleted once answered.
    path = write_table(given.mapInArrow(lambda batches: _asked(batches, bits, block_bytes, shift), kinds)
                       .withColumn("asks", F.col("bucket").isNotNull().cast("int")), scratch_path(spark, "lm_blocks"), partition_by=["asks"])
    blocks = spark.read.schema(T.StructType([*kinds, T.StructField("asks", T.IntegerType())])).parquet(path)
    table = model.counts.select(F.shiftright("key", shift).alias("bucket"), F.lit(-1).cast("bigint").alias("block"), "key", "n0", "n1", "k0", "k1")
    asks = table.unionByName(blocks.where("asks = 1").select("bucket", "block", "at", "n", "asked"), allowMissingColumns=True)
    # One half of the buckets after the other: the disk holds the questions and the table of one.
    answers = functools.reduce(DataFrame.union, [stage_and_free(
        asks.where(half).repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(
            _answers, "block bigint, at bigint, n bigint, answer binary"), "lm_answers") for half in ("bucket < 0", "bucket >= 0")])
    delete_path(spark, f"{path}/asks=1")
    both = answers.unionByName(blocks.where("asks = 0").select("block", "text", "own"), allowMissingColumns=True)
    totals = (model.n_vocab, model.unknown, model.mass, model.scale)

    def scored(parts, seqs, said):
        import pyarrow as pa
        keys = _wanted([x for part in seqs for x in part], bits.value)
        n = np.zeros((4, len(keys)), dtype=np.int64)
        for at, many, packed in said:
            n[:, at:at + many] = unpack_counts(packed, many)
        known = n[0] > 0
        n = n[:, known]
        counts = keys[known], n[:2] - [[1], [0]], n[2:]
        for part, own_seqs in zip(parts, seqs):
            a, c = (np.array(x, dtype=np.float64) for x in zip(*cross_entropies(own_seqs, *counts, *totals)))
            many = pa.array([len(seq) - 2 for seq in own_seqs], pa.int64())
            yield pa.RecordBatch.from_arrays([part["text"], part["own"], many, *map(pa.array, (a, c, a - c))], names=["text", "own", *ADDED])

    def run(batches):
        block, parts, seqs, said = None, [], [], []
        for (at, is_answer), part in _runs(batches, "block", "is_answer"):
            if at != block:
                if parts:
                    yield from scored(parts, seqs, said)
                block, parts, seqs, said = at, [], [], []
            if is_answer:
                said += zip(*[part[c].to_pylist() for c in ("at", "n", "answer")])
            else:
                parts.append(part)
                seqs.append([sequence(t) for t in part["text"].to_pylist()])
        if parts:
            yield from scored(parts, seqs, said)

    made = T.StructType([T.StructField("text", T.StringType()), row_type, T.StructField(ADDED[0], long),
                         *[T.StructField(c, T.DoubleType()) for c in ADDED[1:]]])
    out = (both.withColumn("is_answer", F.col("answer").isNotNull().cast("int")).repartition("block")
           .sortWithinPartitions("block", "is_answer").mapInArrow(run, made))
    back = [F.col("own").getField(c).alias(c) if c in carried else F.col("text").alias(c) for c in own]
    return out.select(*back, *ADDED)


def labelled_target(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose every label is good and not toxic."""
    good = (labels.where(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0"))
    # The labels grow with the corpus: their join never depends on their size.
    return docs.join(good.hint("merge"), id_col, "left_semi").select("text")

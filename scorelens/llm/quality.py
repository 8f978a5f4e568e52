"""Quality classifier by co-training of two views of a document.

* text view: the set of words and of word beginnings (four bytes), and its marks;
* metadata view: source, language, length and layout (shares of capitals, digits, marks and
  line ends, mean word length, share of distinct words).

Two targets are learned alike, ``quality`` and ``toxic``.  Each view has a Bernoulli naive
Bayes model whose counts are summed in Spark over all labelled rows; features without a
significant and strong difference between the classes have no weight.  In every round each view
scores all unlabelled documents, and those it is confident of become pseudo-labelled rows
of the *other* view.  Each view is calibrated on held-out labels, and a logistic model of
both calibrated views gives the final probabilities.  Labelled copies of one text count once.

What reaches the driver is bounded by parameters: the weights that are chosen, of at most
``2 ** TEXT_BITS + 2 ** META_BITS`` features, and the cells of fixed score grids; documents
and counts never do.

Null or empty texts have no words and are judged by metadata; null sources, languages and
lengths are values of their own; a document with several labels takes the least quality and
the greatest toxicity; null labels and ids label nothing; repeated rows score alike; without
labels of both classes of a target its probability is the prior (one half without any
label); empty tables give no rows; other columns are kept, but for those named like an added
one (``ADDED``).
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_hashes, prepare, span_hashes, stage

ADDED = ("quality_score", "toxic_score", "keep")
TEXT_BITS = 18
META_BITS = 12
TARGETS = ("quality", "toxic")
MIN_G = 20.0       # least likelihood-ratio statistic of a feature that has a weight
MIN_WEIGHT = (3.0, 1.5)  # and its least log odds by view: many weak words of a long text would add up
ROUNDS = 2
CONFIDENT = 0.98   # a view's calibrated probability for a pseudo-label
PSEUDO_WEIGHT = 0.5
HOLDOUT = 5        # one labelled text in so many calibrates, the others train
CLIP = 30          # logits are kept within, in grid cells of one half
# Byte classes: 1 letters (with all of UTF-8's upper bytes), 2 marks, 0 white space, digits and others.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[127:] = 1
_KIND[48:58] = 0
for _a, _b in ((65, 91), (97, 123)):
    _KIND[_a:_b] = 1
BEGINNING = 4  # bytes


def text_features(b: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Sorted feature numbers of the text view (runs of letters and of marks, and the
    beginnings of longer words), tokens and distinct tokens; ``b`` are the lower-cased bytes."""
    if not len(b):
        return np.zeros(0, dtype=np.uint32), 0, 0
    kind = _KIND[b]
    at = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    keep = kind[at[:-1]] > 0
    start, end = at[:-1][keep], at[1:][keep]
    prefix = prefix_hashes(b)
    words = np.unique(span_hashes(prefix, start, end))
    long = (kind[start] == 1) & (end - start > BEGINNING)
    heads = span_hashes(prefix, start[long], start[long] + BEGINNING) ^ np.uint64(0x5555555555555555)
    ids = np.unique(np.concatenate([words, heads]) & np.uint64((1 << TEXT_BITS) - 1))
    return ids.astype(np.uint32), len(start), len(words)


def meta_features(b: np.ndarray, source, lang, n_chars, n_words: int, n_kinds: int) -> np.ndarray:
    """Feature numbers of the metadata view; ``b`` are the bytes as they are."""
    n, count = max(len(b), 1), np.bincount(b, minlength=256)
    size = int(math.log2(n))
    upper, lower, digit = count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n
    space, line = count[:33].sum() / n, count[10] / n
    mark = count[33:128].sum() / n - upper - digit - lower
    length = None if n_chars is None else int(math.log2(max(n_chars, 0) + 1))
    names = [f"source={source}", f"lang={lang}", f"length={length}", f"upper={int(upper * 20)}",
             f"digit={int(digit * 20)}", f"mark={int(mark * 25)}", f"line={int(line * 200)}",
             f"word={min(int(1 / max(space, 0.02)), 30)}",
             f"kinds={size}:{int(10 * n_kinds / max(n_words, 1))}"]
    mask = (1 << META_BITS) - 1
    return np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names}), dtype=np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """Sorted distinct numbers as compressed byte planes of their differences."""
    d = np.diff(ids.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _featurize(batch, cols):
    for text, source, lang, n_chars in zip(*[batch[c].to_pylist() for c in cols]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        ids, n_words, n_kinds = text_features(np.frombuffer(raw.lower(), dtype=np.uint8))
        yield raw, ids, meta_features(np.frombuffer(raw, dtype=np.uint8), source, lang, n_chars, n_words, n_kinds)


@dataclass
class Model:
    """Weights ``(target, feature)`` and offsets of both views, their calibration
    ``(slope, offset)`` per target, and the combination ``(text, metadata, offset)``."""
    text: np.ndarray
    meta: np.ndarray
    prior: np.ndarray
    view: np.ndarray       # (target, view, 2)
    both: np.ndarray       # (target, 3)

    def logits(self, ids: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """``(target, view)`` raw logits, clipped."""
        z = np.stack([self.text[:, ids].sum(axis=1), self.meta[:, meta].sum(axis=1)], axis=1)
        return np.clip(z + self.prior[:, None], -CLIP, CLIP)

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        c = self.view[:, :, 0] * z + self.view[:, :, 1]
        x = (self.both[:, :2] * c).sum(axis=1) + self.both[:, 2]
        return 1 / (1 + np.exp(-np.clip(x, -CLIP, CLIP)))


def _logistic(x: np.ndarray, y1: np.ndarray, y0: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; rows of ``x`` are cells with
    ``y1`` positives and ``y0`` negatives.  The last weight is the offset."""
    a = np.column_stack([x, np.ones(len(x))])
    w, n = np.zeros(a.shape[1]), y1 + y0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -CLIP, CLIP)))
        g = a.T @ (y1 - n * p) - ridge * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


BLOCK = 1 << 12
CELLS = (1 << TEXT_BITS) + (1 << META_BITS) + 2  # the last two count rows, by view


def _count(rows: DataFrame, model=None) -> DataFrame:
    """Class counts ``(k, f, n0, n1)`` by target and feature (metadata after text).

    Without a model: labelled rows.  With one: unlabelled rows, each view counting those
    that the other view is confident of."""
    def run(frames):
        import pandas as pd
        n = np.zeros((2, 2, CELLS))
        for f in frames:
            for t, m, q, x in zip(f["ids"], f["meta"], f["quality"], f["toxic"]):
                ids, meta = unpack(t), np.frombuffer(m, dtype="<u2").astype(np.uint32)
                at = (np.append(ids, CELLS - 2), np.append(meta + (1 << TEXT_BITS), CELLS - 1))
                if model is None:
                    for k, label in enumerate((q, x)):
                        if label in (0, 1):
                            for own in at:
                                n[k, int(label), own] += 1
                else:
                    mod = model.value
                    z = mod.logits(ids, meta)
                    p = 1 / (1 + np.exp(-(mod.view[:, :, 0] * z + mod.view[:, :, 1])))
                    for k in range(2):
                        for v in range(2):
                            sure = p[k, 1 - v]
                            if sure >= CONFIDENT or sure <= 1 - CONFIDENT:
                                n[k, int(sure > 0.5), at[v]] += PSEUDO_WEIGHT
        # A task's counts, in compressed blocks of features.
        out = [(k, i, zstandard.compress(n[k, :, i * BLOCK:(i + 1) * BLOCK].astype("<f4").tobytes(), 1))
               for k in range(2) for i in range(-(-CELLS // BLOCK)) if n[k, :, i * BLOCK:(i + 1) * BLOCK].any()]
        yield pd.DataFrame(out, columns=["k", "i", "n"])

    def add(frames):
        import pandas as pd
        total: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for k, i, blob in zip(f["k"], f["i"], f["n"]):
                a = np.frombuffer(zstandard.decompress(blob), dtype="<f4").reshape(2, -1).astype(float)
                total[k, i] = total[k, i] + a if (k, i) in total else a
        for (k, i), a in total.items():  # one array of each block in this partition
            at = np.flatnonzero(a.any(axis=0))
            yield pd.DataFrame({"k": k, "f": at + i * BLOCK, "n0": a[0, at], "n1": a[1, at]})

    return (rows.mapInPandas(run, "k int, i int, n binary").repartition("k", "i")
            .mapInPandas(add, "k int, f int, n0 double, n1 double"))


def _weights(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Naive Bayes log odds of the text and the metadata features, and the prior logits."""
    counts = stage(counts.groupBy("k", "f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "quality_counts")
    text = np.zeros((2, 1 << TEXT_BITS), dtype=np.float32)
    meta = np.zeros((2, 1 << META_BITS), dtype=np.float32)
    total = np.zeros((2, 2, 2))  # target, view, class
    for r in counts.where(F.col("f") >= CELLS - 2).collect():  # at most four rows
        total[r["k"], r["f"] - (CELLS - 2)] = r["n0"], r["n1"]
    for k in range(2):
        for v, (own, lo, hi) in enumerate(((text, 0, 1 << TEXT_BITS), (meta, 1 << TEXT_BITS, CELLS - 2))):
            t0, t1 = total[k, v].tolist()
            if not t0 or not t1:
                continue
            n0, n1 = F.col("n0"), F.col("n1")
            w = F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))

            def part(n, t, t0=t0, t1=t1):  # of the likelihood ratio against the classes' shares
                return F.when(n > 0, n * F.log(n / ((n0 + n1) * (t / (t0 + t1))))).otherwise(0.0)

            chosen = (counts.where((F.col("k") == k) & (F.col("f") >= lo) & (F.col("f") < hi))
                      .select("f", w.alias("w"), (2 * (part(n0, t0) + part(n1, t1))).alias("g"))
                      .where((F.col("g") >= MIN_G) & (F.abs("w") >= MIN_WEIGHT[v])))
            for r in chosen.select("f", "w").collect():  # at most one row per feature
                own[k, r["f"] - lo] = r["w"]
    prior = np.log((total[:, 0, 1] + 0.5) / (total[:, 0, 0] + 0.5))
    return text, meta, prior


def _grid(rows: DataFrame, model) -> dict:
    """Held-out labels by target and cell of the two views' logits (halves)."""
    def run(frames):
        import pandas as pd
        from collections import Counter
        n = Counter()
        for f in frames:
            for t, m, q, x in zip(f["ids"], f["meta"], f["quality"], f["toxic"]):
                z = np.rint(2 * model.value.logits(unpack(t), np.frombuffer(m, dtype="<u2")))
                for k, label in enumerate((q, x)):
                    if label in (0, 1):
                        n[k, int(z[k, 0]), int(z[k, 1]), int(label)] += 1
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["k", "a", "b", "y", "n"])

    pdf = (rows.mapInPandas(run, "k int, a int, b int, y int, n bigint").groupBy("k", "a", "b")
           .agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("y1"), F.sum(F.expr("if(y = 0, n, 0)")).alias("y0"))).toPandas()
    return {k: pdf[pdf["k"] == k] for k in range(2)}


def _calibrated(parts, grid) -> Model:
    text, meta, prior = parts
    view, both = np.zeros((2, 2, 2)), np.zeros((2, 3))
    for k in range(2):
        g = grid[k]
        if not len(g) or not g["y1"].sum() or not g["y0"].sum():
            view[k], both[k] = (0.0, prior[k]), (0.5, 0.5, 0.0)  # the prior
            continue
        y1, y0 = g["y1"].to_numpy(float), g["y0"].to_numpy(float)
        z = np.column_stack([g["a"], g["b"]]) / 2
        for v in range(2):
            view[k, v] = _logistic(z[:, v:v + 1], y1, y0)
        both[k] = _logistic(view[k, :, 0] * z + view[k, :, 1], y1, y0)
    return Model(text, meta, prior, view, both)


def features(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
             lang_col="lang", chars_col="n_chars") -> DataFrame:
    """``(id, h, ids, meta)``: both views of every row, packed; ``h`` is a hash of the text."""
    cols = ["text", "source", "lang", "n_chars"]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            h, ids, meta = [], [], []
            for t, a, b in _featurize(batch, cols):
                h.append(xxhash.xxh64_intdigest(t) >> 1)
                ids.append(pack(a))
                meta.append(b.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(h, pa.int64()), pa.array(ids, pa.binary()), pa.array(meta, pa.binary())],
                names=["id", "h", "ids", "meta"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(chars_col).cast("double").alias("n_chars")).mapInArrow(
        run, f"id {kind}, h bigint, ids binary, meta binary")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", rounds: int = ROUNDS, **cols) -> Model:
    spark = prepare(docs.sparkSession)
    lab = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
           .agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic")))
    # The labels grow with the corpus: their join never depends on their size.
    rows = stage(features(docs, id_col, **cols).join(lab.hint("merge"), "id", "left"), "quality_rows")
    known = rows.where("quality is not null or toxic is not null")
    known = stage(known.dropDuplicates(["h", "quality", "toxic"]).select("h", "ids", "meta", "quality", "toxic"), "quality_known")
    open_rows = rows.where("quality is null and toxic is null")
    held = known.where(f"pmod(h, {HOLDOUT}) = 0")
    base = stage(_count(known.where(f"pmod(h, {HOLDOUT}) <> 0")), "quality_base")
    parts = _weights(base)

    def calibrated(parts):
        raw = spark.sparkContext.broadcast(Model(*parts, np.zeros((2, 2, 2)), np.zeros((2, 3))))
        return _calibrated(parts, _grid(held, raw))

    model = calibrated(parts)
    for _ in range(rounds):
        extra = _count(open_rows, spark.sparkContext.broadcast(model))
        text, meta, _ = _weights(base.unionByName(extra))
        model = calibrated((text, meta, parts[2]))
    return model


def score(docs: DataFrame, model: Model, text_col="text", source_col="source", lang_col="lang",
          chars_col="n_chars", min_quality: float = 0.5, max_toxic: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score``, ``toxic_score`` and ``keep``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    names = [f"__view{i}" for i in range(4)]
    own = [c for c in docs.columns if c not in ADDED]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            p = np.array([shared.value.probabilities(shared.value.logits(a, b))
                          for _, a, b in _featurize(batch, names)]).reshape(-1, 2)
            keep = (p[:, 0] >= min_quality) & (p[:, 1] < max_toxic)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-4], pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(keep)],
                names=[*own, *ADDED])

    given = docs.select(*own, *[F.col(c).cast(t).alias(n) for c, t, n in zip(
        (text_col, source_col, lang_col, chars_col), ("string", "string", "string", "double"), names)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in own)
    return given.mapInArrow(run, f"{kinds}, quality_score double, toxic_score double, keep boolean")

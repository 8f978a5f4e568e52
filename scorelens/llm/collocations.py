"""Phrase collocation mining: best-first branch-and-bound growth of phrases.

Texts (A-Z lower-cased) are split at ``[.,;:!?`` and line ends ``]`` into pieces, these at
spaces and tabs into words.  Counts are per language: ``f`` of a phrase counts all its
occurrences inside pieces.  A candidate is a phrase of 2 to 4 words with ``f >= least``; cut
after its first k words it scores ``floor(2000000 f / (f(first part) + f(rest)))``, and its
lowest cut counts (ties: the smallest k).  A candidate inside a longer one of at least
``cover`` per cent of its count is dropped.  Each language's ``top`` best are returned.

1. Words, then pairs of frequent words, are counted over all documents (a word below
   ``least`` is in no candidate).
2. A phrase that starts with the prefix p and the word w has at most ``f(p)`` occurrences,
   its first cut's left part ``f(w)`` and its right part at least the phrase's own count, so
   no extension of p scores above ``floor(2000000 f(p) / (f(w) + f(p)))``: an admissible bound
   that falls as p grows and is never below p's own score.
3. The frontier is opened best first: all prefixes whose bound reaches the score ``t`` of
   the language's ``first``-th known candidate.  Their three-word and then four-word
   extensions are counted, and left extensions of candidates that score ``t`` or more, as
   these decide which survive.  So all candidates with a score of ``t`` or more are known,
   with their fate.  Do ``top`` of them survive, or is no prefix left, the language is
   settled with all its ties; else ``first`` is made four times as large.

A word is known by a 64-bit hash of its bytes and its language; two words of one hash would
raise an error, not mix counts.  Tasks count segments of about ``SEGMENT`` bytes with numpy
and sum them before anything is shuffled, so a frequent phrase is a row per task.  Which
phrases a pass counts is told to the tasks by bitmaps of ``2**BITS`` bits (8 MB at any size
of the corpus): more phrases set more bits, which costs time but never changes a count.

Null texts are empty, the null language is ``und``; repeated rows count each; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, prefix_hashes, prepare, span_hashes, stage

TOP = 2000
LEAST = 30
COVER = 80       # per cent
FIRST = 4 * TOP  # candidates to settle in the first round
GROW = 4
BITS = 26
SEGMENT = 1 << 20
HELD = 300_000   # distinct words or phrases that a task sums before it hands them on
BUCKETS = 32

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 word, 1 space, 2 break
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


# --- words of a batch of texts

def segments(batch):
    """``(bytes, first byte of each text in it, number of the text, langs)`` of one Arrow
    batch ``(lang, text)``: cut between texts, a longer text between its pieces."""
    text = batch["text"]
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2].to_pybytes() if text.buffers()[2] is not None else b""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        if hi < end:
            hi = int(offsets[np.searchsorted(offsets, hi)])
            if hi - lo > 2 * SEGMENT:  # inside a long text: the next end of a piece
                found = _BREAK.search(data, lo + SEGMENT, hi)
                hi = found.start() if found else hi
        row = int(np.searchsorted(offsets, lo, side="right")) - 1
        stop = int(np.searchsorted(offsets, hi, side="left"))
        yield data[lo:hi].translate(_LOWER), np.maximum(offsets[row:stop] - lo, 0), row
        lo = hi


def words(raw: bytes, at: np.ndarray, keys: np.ndarray):
    """``(hash, piece, start, end, text)`` of each word of a segment whose texts begin at
    ``at``; ``keys`` holds the hash of each text's language."""
    kind = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    word = kind == 0
    new = np.zeros(len(raw), dtype=bool)
    new[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | new[1:]
    ends[:-1] &= ~word[1:] | new[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    piece = np.cumsum((kind == 2) | new, dtype=np.int32)[start]
    text = np.searchsorted(at, start, side="right") - 1
    h = span_hashes(prefix_hashes(np.frombuffer(raw, dtype=np.uint8)), start, end)
    return mix64(h ^ keys[text]), piece, start, end, text


def _lang_key(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _read(batches):
    """Words of every segment, with the names of the texts' languages."""
    for batch in batches:
        langs = batch["lang"].to_pylist()
        known = {x: _lang_key(x) for x in set(langs)}
        keys = np.array([known[x] for x in langs], dtype=np.uint64)
        for raw, at, row in segments(batch):
            part = keys[row:row + len(at)]
            yield raw, langs[row:row + len(at)], words(raw, at, part)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# --- counting passes

def count_words(rows: DataFrame) -> DataFrame:
    """``(u, lang, word, f)`` of all words of ``rows (lang, text)``."""
    def run(batches):
        import pyarrow as pa
        held: dict[int, list] = {}

        def made():
            u = np.fromiter(held, dtype=np.uint64, count=len(held)).view(np.int64)
            lang, word, f = zip(*held.values()) if held else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(lang, pa.string()), pa.array([w.decode("utf-8", "replace") for w in word], pa.string()),
                 pa.array(f, pa.int64())], names=["u", "lang", "word", "f"])

        for raw, langs, (u, _, start, end, text) in _read(batches):
            own, first, f = np.unique(u, return_index=True, return_counts=True)
            for k, n, a, b, t in zip(own.tolist(), f.tolist(), start[first].tolist(), end[first].tolist(), text[first].tolist()):
                if k in held:
                    held[k][2] += n
                else:
                    held[k] = [langs[t], raw[a:b], n]
            if len(held) > HELD:
                yield made()
                held = {}
        yield made()

    found = rows.mapInArrow(run, "u bigint, lang string, word string, f bigint")
    name = F.struct("lang", "word")
    found = found.groupBy("u").agg(F.min(name).alias("name"), F.max(name).alias("other"), F.sum("f").alias("f"))
    same = F.when(F.col("name") == F.col("other"), F.col("f")).otherwise(
        F.raise_error(F.lit("two words have the same 64-bit hash")).cast("bigint"))
    return found.select("u", "name.lang", "name.word", same.alias("f"))


def fold(cols: list) -> Column:
    """One number of up to four word hashes (as ``_fold`` in the tasks)."""
    out = F.col(cols[0])
    for i, c in enumerate(cols[1:], 1):
        turned = F.shiftleft(c, 21 * i).bitwiseOR(F.shiftrightunsigned(c, 64 - 21 * i))
        out = out.bitwiseXOR(turned)
    return out


def _fold(cols: list[np.ndarray]) -> np.ndarray:
    out = cols[0]
    for i, c in enumerate(cols[1:], 1):
        out = out ^ ((c << np.uint64(21 * i)) | (c >> np.uint64(64 - 21 * i)))
    return out


def bitmap(df: DataFrame, cols: list[str]) -> bytes:
    """``2**BITS`` bits with those of the rows' folded hashes set."""
    at = df.select(F.shiftrightunsigned(fold(cols), 64 - BITS).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).cast("int").alias("k")).agg(
        F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = bytearray(1 << (BITS - 3))
    for k, bits in parts.collect():  # at most 2 ** (BITS - 15) rows of 4 KB
        out[k * 4096:(k + 1) * 4096] = bits
    return bytes(out)


def count_phrases(rows: DataFrame, m: int, wanted: list[list[tuple]], bits: dict[str, bytes]) -> DataFrame:
    """``(u1 .. um, f)`` of the phrases of ``m`` words that pass one of the lists in
    ``wanted``: of each ``(first word, number of words, bitmap)`` in the list those words'
    bit is set.  A phrase that passes is counted wherever it occurs."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    names = [f"u{i + 1}" for i in range(m)]

    def run(batches):
        import pyarrow as pa
        maps = {k: np.frombuffer(v, dtype=np.uint8) for k, v in sent.value.items()}
        held: list[list[np.ndarray]] = []
        waiting = 0

        def passes(cols):
            known: dict = {}

            def on(first, n, name):
                if (first, n, name) not in known:
                    at = (_fold(cols[first:first + n]) >> np.uint64(64 - BITS)).astype(np.int64)
                    known[first, n, name] = (maps[name][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                return known[first, n, name]

            return reduce(np.logical_or, [reduce(np.logical_and, [on(*x) for x in way]) for way in wanted])

        def summed(parts):
            cols = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(_fold(cols[:m]))
            cols = [x[order] for x in cols]
            new = np.ones(len(order), dtype=bool)
            if len(order):
                new[1:] = reduce(np.logical_or, [x[1:] != x[:-1] for x in cols[:m]])
            first = np.flatnonzero(new)
            f = np.add.reduceat(cols[m], first) if len(first) else cols[m]
            return [*[x[first] for x in cols[:m]], f]

        def made(cols):
            return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in cols[:m]], pa.array(cols[m])],
                                              names=[*names, "f"])

        for _, _, (u, piece, *_) in _read(batches):
            n = len(u) - m + 1
            if n <= 0:
                continue
            inside = np.flatnonzero(piece[:n] == piece[m - 1:])
            cols = [u[inside + i] for i in range(m)]
            take = passes(cols)
            held.append(summed([[*[x[take] for x in cols], np.ones(int(take.sum()), dtype=np.int64)]]))
            waiting += len(held[-1][0])
            if waiting > 4 * HELD:
                held = [summed(held)]
                waiting = len(held[0][0])
                if waiting > 2 * HELD:
                    yield made(held[0])
                    held, waiting = [], 0
        if held:
            yield made(summed(held))

    found = rows.mapInArrow(run, ", ".join(f"{x} bigint" for x in names) + ", f bigint")
    return found.groupBy(*names).agg(F.sum("f").alias("f"))


# --- scores

def points(a: str, left: str, right: str) -> Column:
    """``floor(2000000 a / (left + right))`` of SQL expressions, by decimals: the product may
    pass 64 bits."""
    def wide(x):
        return f"cast({x} as decimal(20,0))"

    return F.expr(f"{wide(a)} * cast(2000000 as decimal(7,0)) div ({wide(left)} + {wide(right)})")


def _cuts(m: int) -> Column:
    """The best cut ``(score, k, l, r)`` of ``l1, r1 .. l(m-1), r(m-1)``: the lowest score,
    of equals the smallest k."""
    cuts = [F.struct(points("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]
    return F.array_min(F.array(*cuts))


def _with(df: DataFrame, table: DataFrame, of: list[str], name: str, how: str = "inner", extra=()) -> DataFrame:
    """``df`` with the count ``name`` that ``table`` has of the words ``of``."""
    keys = [f"u{i + 1}" for i in range(len(of))]
    t = table.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("f").alias(name), *extra)
    on = reduce(lambda x, y: x & y, [df[a] == t[f"_{k}"] for a, k in zip(of, keys)])
    return df.join(t, on, how).drop(*[f"_{k}" for k in keys])


def _scored(df: DataFrame, m: int) -> DataFrame:
    """Adds the best cut and the bound of all phrases that start with this one."""
    names = [f"u{i + 1}" for i in range(m)]
    return df.withColumn("cut", _cuts(m)).select(
        *names, "lang", "f", "cut.score", "cut.l", "cut.r", points("f", "l1", "f").alias("bound"))


def thresholds(known: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, t)``: the score of the ``first``-th best known candidate of each language in
    ``langs (lang, first)``; 0 where there are fewer.  Scores are at most 1,000,000, so a
    language has no more rows here."""
    steps = known.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n")).join(langs, "lang")
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reached = steps.withColumn("n", so_far).where("n >= first").groupBy("lang").agg(F.max("score").alias("t"))
    return langs.join(reached, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("bigint").alias("t"))


def _bigrams(rows, vocabulary, least) -> DataFrame:
    pairs = count_phrases(rows, 2, [[(0, 1, "word"), (1, 1, "word")]], {"word": bitmap(vocabulary, ["u1"])})
    pairs = _with(pairs.where(F.col("f") >= least), vocabulary, ["u1"], "l1", extra=["lang"])
    return stage(_scored(_with(pairs, vocabulary, ["u2"], "r1"), 2), "phrase_pairs")


def _settle(rows, vocabulary, two, limits, least, cover, pair_bits) -> tuple[DataFrame, DataFrame]:
    """``(all known candidates, survivors)`` with a score of ``t`` or more in the languages of
    ``limits (lang, t)``."""
    def reach(df, column):
        return df.join(limits, "lang").where(F.col(column) >= F.col("t")).drop("t")

    bits = {"pair": pair_bits, "open": bitmap(reach(two, "bound"), ["u1", "u2"]),
            "settle": bitmap(reach(two, "score"), ["u1", "u2"])}
    three = count_phrases(rows, 3, [[(0, 2, "open"), (1, 2, "pair")], [(0, 2, "pair"), (1, 2, "settle")]], bits)
    three = three.where(F.col("f") >= least)
    three = _with(three, vocabulary, ["u1"], "l1", extra=["lang"])
    three = _with(_with(three, two, ["u2", "u3"], "r1"), two, ["u1", "u2"], "l2")
    three = stage(_scored(_with(three, vocabulary, ["u3"], "r2"), 3), "phrase_triples")

    bits = {"pair": pair_bits, "open": bitmap(reach(three, "bound"), ["u1", "u2", "u3"]),
            "settle": bitmap(reach(three, "score"), ["u1", "u2", "u3"])}
    four = count_phrases(rows, 4, [[(0, 3, "open"), (2, 2, "pair")], [(0, 2, "pair"), (1, 3, "settle")]], bits)
    four = four.where(F.col("f") >= least)
    four = _with(four, vocabulary, ["u1"], "l1", extra=["lang"])
    four = _with(_with(four, two, ["u1", "u2"], "l2"), two, ["u3", "u4"], "r2")
    four = _with(_with(four, three, ["u1", "u2", "u3"], "l3", "left"), vocabulary, ["u4"], "r3")
    four = stage(_with(four, three, ["u2", "u3", "u4"], "r1", "left"), "phrase_fours")
    # Those that can reach t by the cuts known so far need the counts of both their triples.
    high = points("f", "l1", "f")
    for cut in (("l2", "r2"), ("coalesce(l3, f)", "r3")):
        high = F.least(high, points("f", *cut))
    able = four.withColumn("high", high)
    able = reach(able, "high").drop("high")
    lack = able.where("l3 IS NULL").select("u1", "u2", "u3").unionByName(
        able.where("r1 IS NULL").select(F.col("u2").alias("u1"), F.col("u3").alias("u2"), F.col("u4").alias("u3")))
    lack = stage(lack.distinct(), "phrase_lack")
    if lack.head(1):
        more = count_phrases(rows, 3, [[(0, 3, "lack")]], {"lack": bitmap(lack, ["u1", "u2", "u3"])})
        more = stage(more, "phrase_more")
        able = _with(_with(able, more, ["u1", "u2", "u3"], "l3b", "left"), more, ["u2", "u3", "u4"], "r1b", "left")
        able = able.withColumn("l3", F.coalesce("l3", "l3b")).withColumn("r1", F.coalesce("r1", "r1b"))
    full = stage(_scored(able, 4), "phrase_scored")

    def covered(longer, m):
        """The most occurrences of a phrase that is one word longer, by the phrase it holds."""
        names = [f"u{i + 1}" for i in range(m)]
        ways = [longer.select(*[F.col(f"u{i + 1 + d}").alias(n) for i, n in enumerate(names)], "f") for d in (0, 1)]
        return ways[0].unionByName(ways[1]).groupBy(*names).agg(F.max("f").alias("f"))

    out = []
    for df, longer, m in ((two, three, 2), (three, four, 3)):
        names = [f"u{i + 1}" for i in range(m)]
        df = _with(reach(df, "score"), covered(longer, m), names, "most", "left")
        kept = F.coalesce(F.col("most").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * cover, F.lit(True))
        out.append(df.withColumn("kept", kept).drop("most"))
    out.append(reach(full, "score").withColumn("kept", F.lit(True)))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    known = reduce(lambda a, b: a.unionByName(b), [x.select("lang", "score") for x in (two, three, full)])
    return known, stage(found, "phrase_settled")


def _best(survivors: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` by score and count, with all ties: first in buckets."""
    order = [F.desc("score"), F.desc("f")]
    out = survivors.withColumn("_b", F.pmod(fold(["u1", "u2"]), F.lit(BUCKETS)))
    for keys in (["lang", "_b"], ["lang"]):
        out = out.withColumn("_k", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= top)
    return out.drop("_b", "_k")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP,
                 least: int = LEAST, cover: int = COVER, first: int | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases; ``a``,
    ``l`` and ``r`` are the counts of the phrase and of its best cut's parts, ``n`` all words."""
    if not (top > 0 and least > 0 and cover > 0):
        raise ValueError("top, least and cover must be positive")
    prepare(docs.sparkSession)
    first = first or FIRST * top // TOP + 1
    rows = _rows(docs, text_col, lang_col)
    counted = stage(count_words(rows), "phrase_words")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = stage(counted.where(F.col("f") >= least).withColumnRenamed("u", "u1"), "phrase_vocabulary")
    two = _bigrams(rows, vocabulary, least)
    pair_bits = bitmap(two, ["u1", "u2"])
    open_langs = stage(two.groupBy("lang").agg(F.lit(first).cast("bigint").alias("first")), "phrase_langs")
    known, settled = two, None
    while open_langs.head(1):
        limits = stage(thresholds(known.select("lang", "score"), open_langs), "phrase_limits")
        known, found = _settle(rows, vocabulary, two, limits, least, cover, pair_bits)
        counts = found.groupBy("lang").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("all"))
        counts = stage(limits.join(counts, "lang", "left").fillna(0), "phrase_counts")
        done = counts.where((F.col("kept") >= top) | (F.col("t") == 0))
        part = found.where("kept").join(done.select("lang"), "lang", "left_semi").drop("kept")
        settled = part if settled is None else settled.unionByName(part)
        left = counts.join(done.select("lang"), "lang", "left_anti").select("lang", "all")
        open_langs = stage(open_langs.join(left, "lang").select(
            "lang", (F.greatest("first", "all") * GROW).alias("first")), "phrase_langs")
    none = two.limit(0).select("*", *[F.lit(None).cast("bigint").alias(x) for x in ("u3", "u4")])
    best = stage(_best(none if settled is None else settled.select(none.columns), top), "phrase_best")
    for i in range(1, 5):
        w = vocabulary.select(F.col("u1").alias("_u"), F.col("word").alias(f"w{i}"))
        best = best.join(w, best[f"u{i}"] == w["_u"], "left").drop("_u")
    best = best.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), F.col("f").alias("a"),
                       "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(docs: list[tuple], top: int = TOP, least: int = LEAST, cover: int = COVER) -> list[tuple]:
    """The result's rows by counting all phrases of ``(lang, text)`` in dictionaries (tests)."""
    from collections import Counter, defaultdict

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= cover * c[p[i:j]]}
        rows = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)

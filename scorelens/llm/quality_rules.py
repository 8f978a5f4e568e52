"""Quality rules as a short-circuit cascade.

Each rule says from a text whether it fails.  On a sample (one distinct text in
``SAMPLE_EVERY``, chosen by hash, so it is spread over all tasks) every rule is run and
timed; the sums per rule give its cost and the share it rejects.  Rules then run in the order
of rejection per cost, and a document's first failure ends its cascade: cheap rules that
reject much spare the others their work.  The verdict does not depend on the order, which
rule is named as the failed one does.

The base figures come first: words are runs without white space, ``word_chars`` their code
points, ``n_symbols`` the characters ``#*$%&|<>``, ``n_dup_lines`` lines with a word that are equal
to an earlier line, ``n_repeat_words`` words inside windows of ``WINDOW`` words that stand twice or more in
the text.  A document of fewer than ``MIN_WORDS`` words, or with over ``REPEAT`` per cent of its words
repeated, fails the base and runs no rule.

Null and empty texts have no words and fail the base; repeated rows are judged alike; null ids
are kept as they are; an empty table gives no rows, and rules keep their given order where the
sample is empty.  Other columns are kept, but for those named like an added one.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare

WINDOW = 8
MIN_WORDS = 20
REPEAT = 30
SAMPLE_EVERY = 50
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_rules")

_WORD = re.compile("[^\x20\x09-\x0D]+")
_SPACE = " \t\n\x0b\x0c\r"
_LETTERS = re.compile(r"[^\W\d_]+")
# A general list of insults; a parameter of ``insults``.
INSULTS = frozenset("""
arschloch asshole bastard bitch clown connard crétin cretin cunt depp disgusting dumbass estúpido fool freak
garbage idiot idiota idioten imbecile imbécil imbécile inútil jackass jerk loser lowlife moron moronic nutjob
pathetic pendejo pervers puta salaud salope scum scumbag shithead slut stupid stupide trash trottel twat
versager whore worthless
""".split())


class Doc:
    """A text with the figures that rules share, each made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORD.findall(self.text)

    @cached_property
    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        known: dict[str, int] = {}
        of = known.setdefault
        out = np.fromiter((of(w, len(known)) for w in self.words), dtype=np.int64, count=len(self.words))
        self.__dict__["distinct"] = known
        return out

    @cached_property
    def distinct(self) -> dict[str, int]:
        self.numbers
        return self.__dict__["distinct"]

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = len(self.words) - WINDOW + 1
        if n < 2 or len(self.distinct) == len(self.words):
            return 0
        w = self.numbers
        mixed = mix64(w.astype(np.uint64) + np.uint64(1))
        h = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[i:i + n]
        order = np.argsort(h, kind="stable")
        s = h[order]
        equal = np.flatnonzero(s[1:] == s[:-1])
        if not len(equal):
            return 0
        at = np.arange(WINDOW)
        a, b = order[equal], order[equal + 1]
        if (w[a[:, None] + at] == w[b[:, None] + at]).all():
            twice = np.concatenate([a, b])
        else:  # different windows of one hash: compare the windows themselves
            windows = Counter(map(tuple, np.lib.stride_tricks.sliding_window_view(w, WINDOW).tolist()))
            twice = np.array([i for i in range(n) if windows[tuple(w[i:i + WINDOW].tolist())] > 1], dtype=np.int64)
        edge = np.zeros(len(w) + 1, dtype=np.int64)
        twice = np.unique(twice)
        edge[twice] += 1
        edge[twice + WINDOW] -= 1
        return int((np.cumsum(edge) > 0).sum())

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < MIN_WORDS or 100 * self.n_repeat_words > REPEAT * n


Rule = Callable[[Doc], bool]


def word_length(d: Doc) -> bool:
    """Mean word length below 2.5 or above 12 characters."""
    return not 25 * len(d.words) <= 10 * d.word_chars <= 120 * len(d.words)


def symbols(d: Doc) -> bool:
    """More than one symbol for ten words."""
    return 10 * d.n_symbols > len(d.words)


def dup_lines(d: Doc) -> bool:
    """Over 40 per cent of the lines stand earlier."""
    return 100 * d.n_dup_lines > 40 * len(d.lines)


def capitals(d: Doc) -> bool:
    """Over 30 per cent of the words in capitals."""
    return 100 * sum(map(str.isupper, d.words)) > 30 * len(d.words)


def exclamations(d: Doc) -> bool:
    """More than one double exclamation or question mark for ten words."""
    return 10 * (d.text.count("!!") + d.text.count("??")) > len(d.words)


def letters(d: Doc) -> bool:
    """Over 30 per cent of the words without a letter."""
    return 100 * sum(_LETTERS.search(w) is None for w in d.words) > 30 * len(d.words)


def insults(d: Doc, listed: frozenset = INSULTS) -> bool:
    """Two insults or more, and more than one for 500 words."""
    bad = {k for w, k in d.distinct.items() if not listed.isdisjoint(_LETTERS.findall(w.lower()))}
    hits = int(np.isin(d.numbers, list(bad)).sum()) if bad else 0
    return hits >= 2 and 500 * hits > len(d.words)


RULES: dict[str, Rule] = {f.__name__: f for f in (word_length, symbols, dup_lines, capitals, exclamations, letters, insults)}


def estimate(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None,
             every: int = SAMPLE_EVERY) -> DataFrame:
    """``(rule, n, rejected, ns)``: sampled documents that pass the base, how many of them each rule
    rejects and the nanoseconds it took; one row per rule."""
    prepare(docs.sparkSession)
    rules = RULES if rules is None else rules
    sample = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches):
        import pyarrow as pa
        sums = {k: [0, 0, 0] for k in rules}
        for batch in batches:
            for text in batch["text"].to_pylist():
                d = Doc(text)
                if d.base_failed:
                    continue
                for k, rule in rules.items():
                    own = Doc(None)  # figures that a rule makes for itself belong to its cost
                    own.text, own.words = d.text, d.words
                    began = time.perf_counter_ns()
                    failed = rule(own)
                    took = time.perf_counter_ns() - began
                    sums[k] = [x + y for x, y in zip(sums[k], (1, bool(failed), took))]
        n, rejected, ns = zip(*sums.values()) if sums else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array(x, pa.int64()) for x in (n, rejected, ns)]],
                                         names=["rule", "n", "rejected", "ns"])

    found = sample.mapInArrow(run, "rule string, n bigint, rejected bigint, ns bigint")
    return found.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("n", "rejected", "ns")])


def order_of(estimates: list, rules: dict[str, Rule]) -> list[str]:
    """Rule names by rejection per cost, the best first; shares are smoothed, as a small sample
    may show no rejection, and unmeasured rules follow in their given order."""
    known = {r["rule"]: r for r in estimates if r["n"]}
    place = {k: i for k, i in zip(rules, count())}

    def worth(k):
        r = known.get(k)
        return 0.0 if r is None else (r["rejected"] + 0.5) / (r["n"] + 1) / max(r["ns"] / r["n"], 1.0)

    return sorted(rules, key=lambda k: (-worth(k), place[k]))


def judge(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None,
          order: list[str] | None = None, every: int = SAMPLE_EVERY) -> DataFrame:
    """``docs`` with the base figures, ``base_failed``, ``kept``, ``failed`` (``base`` or the rule that
    ended the cascade, null if kept) and ``n_rules`` (rules that ran).  ``order`` spares the sample."""
    prepare(docs.sparkSession)
    rules = RULES if rules is None else rules
    if order is None:
        order = order_of(estimate(docs, text_col, rules, every).collect(), rules)
    steps = [(k, rules[k]) for k in order]
    own = [c for c in docs.columns if c not in ADDED]
    frame = docs.select(*own, F.col(text_col).cast("string").alias("__text"))
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
            "base_failed boolean, kept boolean, failed string, n_rules int"

    def run(batches):
        import pyarrow as pa
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for text in batch["__text"].to_pylist():
                d = Doc(text)
                base, failed, ran = d.base_failed, None, 0
                if base:
                    failed = "base"
                else:
                    for ran, (k, rule) in enumerate(steps, 1):
                        if rule(d):
                            failed = k
                            break
                rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, base,
                             failed is None, failed, ran))
            cols = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in own], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*own, *ADDED])

    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in own])
    return frame.mapInArrow(run, StructType(schema.fields + StructType.fromDDL(kinds).fields))

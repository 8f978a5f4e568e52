"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds (leftmost, non-overlapping, then filtered by length): ``assign``, ``access`` and
``hex``.  The method adds the kind ``entropy``: candidate strings are long runs of key
characters with a letter and a digit; each belongs to the narrowest character class that
holds it, and the Shannon entropy of every window of ``WINDOW`` characters is kept up by
counts that change by one character in and one out.  A candidate is a secret when its best
window reaches the class's threshold.  The allow-list frees stretches, not candidates: no
window may touch a stretch of a known sequence or of one repeated character, or a path
segment (between slashes) that holds a placeholder word; what is left is judged.  Only a
UUID is freed as a whole.  Base spans are never suppressed, and an entropy span may overlap
one.

Null texts count as empty; repeated rows each give their row; an empty table gives none;
other columns are kept.  Positions are code points, the end exclusive.  Only built-in
functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"   # runs of 18 and more: the same as matching and then filtering
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_MIN = 12
WINDOW = 20
# Character classes from narrow to wide: name, alphabet, entropy threshold in bits.
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 3.02),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.42),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.82),
)
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?",
    r"(?i)abcdefgh|01234567|12345678|(.)\1{5}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
# What is cut out of a candidate; a segment is tried from its start only, so long ones stay linear.
FREED = rf"(?<![^/])[^/]*(?:{ALLOW[0]})[^/]*|(?:{ALLOW[1]})"


def _placed(text: Column, pattern: str, checked: Column | None = None) -> Column:
    """Arrays of ``(start, stop, value, checked)`` of all matches, from the pieces between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    check = checked if checked is not None else found
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    spans = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                   lambda g, m: F.struct(g.alias("gap"), F.char_length(m).alias("n"))), zero,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"),
                                                (a["at"] + x["gap"] + x["n"]).alias("stop")))).alias("out")),
        lambda a: a["out"])
    pairs = F.zip_with(found, check, lambda m, c: F.struct(m.alias("value"), c.alias("checked")))
    return F.zip_with(spans, pairs, lambda s, p: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), p["value"].alias("value"),
        p["checked"].alias("checked")))


def best_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of any window of the string; counts per character
    and the sum of n log2 n change by the character that enters and the one that leaves."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("s"),
                    F.lit(0.0).alias("best"))

    def over(at):
        def step(a, i):
            new = F.get(at, i)
            old = F.coalesce(F.get(at, i - window), F.lit(-1))
            c_new, c_old = F.get(a["n"], new), F.get(a["n"], old)
            s = F.when(new == old, a["s"]).otherwise(
                a["s"] + F.get(f, c_new + 1) - F.get(f, c_new)
                - F.coalesce(F.get(f, c_old) - F.get(f, c_old - 1), F.lit(0.0)))
            counts = F.transform(a["n"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int"))
            best = F.when(i >= window - 1, F.greatest(a["best"], F.lit(math.log2(window)) - s / window)).otherwise(a["best"])
            return F.struct(counts.alias("n"), s.alias("s"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), zero, step, lambda a: a["best"])

    # A one-element array binds the characters' places once for all steps.
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.get(F.transform(F.array(at), over), 0)


def is_high_entropy(value: Column, window: int = WINDOW) -> Column:
    """True for a candidate of which a window outside the freed stretches reaches its class's threshold."""
    pieces = F.filter(F.split(value, FREED, -1), lambda p: F.char_length(p) >= window)
    verdict = None
    for _, alphabet, limit in reversed(CLASSES):
        fits = F.translate(value, alphabet, "") == ""
        here = F.exists(pieces, lambda p: best_entropy(p, alphabet, window) >= limit)  # noqa: B023
        verdict = F.when(fits, here) if verdict is None else F.when(fits, here).otherwise(verdict)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(ALLOW[2]) & F.coalesce(verdict, F.lit(False))


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))).cast(SPAN)


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``out``: spans ``(start, rank, kind, stop)`` by start, then kind."""
    prepare(docs.sparkSession)
    t = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    low = F.lower(t)
    named = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    assign = F.filter(_placed(t, ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))),
                      lambda s: F.char_length(s["checked"]) >= ASSIGN_MIN)
    df = docs.withColumn("_assign", F.when(named, _spans(assign, "assign")).otherwise(none))
    df = df.withColumn("_access", F.when(F.contains(t, F.lit("AKIA")), _spans(_placed(t, ACCESS), "access")).otherwise(none))
    df = df.withColumn("_hex", F.when(t.rlike(HEX), _spans(_placed(t, HEX), "hex")).otherwise(none))
    cand = F.filter(_placed(t, CANDIDATE), lambda s: is_high_entropy(s["value"], window))
    df = df.withColumn("_entropy", F.when(t.rlike(CANDIDATE), _spans(cand, "entropy")).otherwise(none))
    df = df.withColumn(out, F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy")))
    return df.drop("_assign", "_access", "_hex", "_entropy")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark`` (overlapping spans by
    one mark); texts without secrets, null ones too, stay as they are.  ``length_col`` is
    set to the new length where the text changed."""
    found = scan(docs, text_col, "_spans")
    t = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    built = F.aggregate(
        "_spans", zero,
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            s["stop"].alias("at"),
            F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    hit = F.size("_spans") > 0
    out = found.withColumn("_new", F.when(hit, built).otherwise(t))
    if length_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(hit, F.char_length("_new").cast(kind)).otherwise(F.col(length_col)))
    return out.withColumn(text_col, F.col("_new")).select(*docs.columns)

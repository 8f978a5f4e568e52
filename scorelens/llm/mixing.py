"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are summed into (source, language, topic) cells of tokens.  Raking multiplies
the cells' weights, one margin after the other, until every margin meets its target share.
A document's weight is its cell's raked share over the cell's share of tokens; it is kept
with probability ``min(1, rate * weight)`` and carries ``sample_weight = weight /
probability``, so that the weighted tokens of the sample meet the targets in expectation.
The draw is a hash of seed and id: the same for any partitioning or restart.

Cells are grouped to one row per source; languages and topics are few (``MAX_PAIRS`` pairs of
them at most, else ``ValueError``), so their factors are numbers in the plan.  A round is one job:
each source's factor follows from its own row, and what all sources then hold of each
(language, topic) is summed.  These sums give the other two factors and the error, so every
round has the same small plan and nothing is written; sources may be any number.

Null sources and languages form the value ``(null)``; null or empty texts have no tokens,
weight 0 and stay out; repeated rows are drawn alike; a target value without tokens is left
out and the rest rescaled; a value without a target gets weight 0; empty tables give no
rows; other columns are kept, but for those named like an added one (``ADDED``).  Only
built-in functions are used.  Raking ends when the largest difference of a margin from its
target is at most ``TOL``.  Margins that contradict each other have no solution: there it ends
when the error has stopped falling.  An error that stays is told in a warning and stands in the
column ``margin_error``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

DIMS = ("source", "lang", "topic")
TEMPER = 0.7   # default target: share ** TEMPER, rescaled
MAX_ROUNDS = 2000
TOL = 1e-11     # largest difference of a margin's share from its target
STALLED = 1e-3  # relative change of the error in LOOK rounds below which it no longer falls
LOOK = 6
INNER = 50      # fits of languages and topics to one round's sums
MAX_PAIRS = 100_000  # languages times topics
SEED = 17
ADDED = ("_source", "_lang", "_topic", "_tokens", "_u", "weight", "probability", "sample_weight", "sampled", "margin_error")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("bigint")


def default_topic(text: Column, tokens: Column) -> Column:
    """Genre by layout, and by length for plain prose."""
    t = F.coalesce(text, F.lit(""))

    def share(mark: str) -> Column:
        gone = F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
        return gone / len(mark) / F.greatest(tokens, F.lit(1))

    return (F.when(share(" | ") > 0.2, "table").when(share("!!") > 0.2, "shout")
            .when(tokens < 100, "short").when(tokens < 300, "medium")
            .when(tokens < 1500, "long").otherwise("book"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
             seed: int = SEED) -> DataFrame:
    """``docs`` with ``_source, _lang, _tokens, _topic, _u`` (the draw, from 0 to 1)."""
    null = F.lit("(null)")
    out = (docs.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), null))
           .withColumn("_lang", F.coalesce(F.col(lang_col).cast("string"), null))
           .withColumn("_tokens", n_tokens(F.col(text_col))))
    out = out.withColumn("_topic", topic if topic is not None
                         else default_topic(F.col(text_col), F.col("_tokens")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), null))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return out.withColumn("_u", draw)


def tempered_targets(cells: DataFrame, temper: float = TEMPER) -> DataFrame:
    """``(dim, value, share)``: each margin's shares to the power ``temper``, rescaled."""
    total = None
    for d in DIMS:
        m = (cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
             .select(F.lit(d).alias("dim"), "value", F.pow(F.col("t").cast("double"), F.lit(temper)).alias("share")))
        total = m if total is None else total.unionByName(m)
    return total


def _margin(there: DataFrame, targets: DataFrame, d: str) -> DataFrame:
    """``(value, target)`` of the values that have tokens, rescaled to one."""
    own = targets.where(F.col("dim") == d).groupBy("value").agg(F.sum("share").alias("share"))
    own = there.groupBy(F.col(d).alias("value")).agg(F.lit(1).alias("one")).join(own, "value", "left")
    one = own.agg(F.sum("share")).first()[0]
    return own.select("value", F.coalesce(F.col("share") / F.lit(one or 1.0), F.lit(0.0)).alias("target"))


def _fit(sums: dict[tuple[int, int], float], target: list[float], at: int, other: list[float]) -> list[float]:
    """The factors of one margin of the (language, topic) sums, given the other's."""
    now = [0.0] * len(target)
    for pair, x in sums.items():
        now[pair[at]] += x * other[pair[1 - at]]
    return [t / x if x > 0 else 0.0 for t, x in zip(target, now)]


def _gap(sums, factors, targets) -> float:
    """Largest difference of the languages' and topics' shares from their targets."""
    now = [[0.0] * len(t) for t in targets]
    for (l, t), x in sums.items():
        x *= factors[0][l] * factors[1][t]
        now[0][l] += x
        now[1][t] += x
    return max(abs(x - y) for n, t in zip(now, targets) for x, y in zip(n, t))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = MAX_ROUNDS, tol: float = TOL) -> tuple[DataFrame, float]:
    """``cells`` ``(source, lang, topic, tokens)`` with ``share``, raked to the margins in at most
    ``rounds`` rounds, and the largest error that stays."""
    there = cells.where("tokens > 0")
    whole = there.agg(F.sum("tokens").cast("double")).first()[0]
    if not whole:
        return cells.withColumn("share", F.lit(0.0)), 0.0
    small = [_margin(there, targets, d).orderBy("value").limit(MAX_PAIRS + 1).collect() for d in DIMS[1:]]
    if len(small[0]) * len(small[1]) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of language and topic")
    names = [F.lit([r["value"] for r in m]) for m in small]
    wanted = [[r["target"] for r in m] for m in small]
    cell = F.struct(*[(F.array_position(n, F.col(d)) - 1).cast("int").alias(d) for n, d in zip(names, DIMS[1:])],
                    "tokens", (F.col("tokens") / F.lit(whole)).alias("base"))
    rows = there.groupBy("source").agg(F.collect_list(cell).alias("cells"))
    rows = stage(rows.join(_margin(there, targets, "source").withColumnRenamed("value", "source"), "source"), "mix_sources")
    factors = [[1.0] * len(w) for w in wanted]

    def raked():
        """Every cell with its share: its source's factor makes the source's sum the target."""
        lang, topic = (F.lit(f) for f in factors)

        def part(x):
            return x["base"] * F.element_at(lang, x["lang"] + 1) * F.element_at(topic, x["topic"] + 1)

        mass = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + part(x))
        a = F.when(mass > 0, F.col("target") / mass).otherwise(0.0)
        out = rows.select("source", a.alias("a"), F.explode("cells").alias("x"))
        return out.select("source", "x", (F.col("a") * part(F.col("x"))).alias("share"), "a")

    last, error, i = float("inf"), float("inf"), 0
    for i in range(1, rounds + 1):
        sums = {(r[0], r[1]): r[2] for r in raked().groupBy("x.lang", "x.topic").agg(
            F.sum(F.col("a") * F.col("x.base"))).collect()}
        error = _gap(sums, factors, wanted)
        if error <= tol or i == rounds:
            break
        if i % LOOK == 0:
            if abs(last - error) <= STALLED * error:
                break
            last = error
        for _ in range(INNER):
            factors[0] = _fit(sums, wanted[0], 0, factors[1])
            factors[1] = _fit(sums, wanted[1], 1, factors[0])
            if _gap(sums, factors, wanted) <= tol / 2:
                break
    if error > tol:
        warnings.warn(f"the margins do not meet their targets: largest error {error:.3g} after {i} rounds",
                      RuntimeWarning, stacklevel=2)
    found = raked().select("source", *[F.element_at(n, F.col(f"x.{d}") + 1).alias(d) for n, d in zip(names, DIMS[1:])],
                           "x.tokens", "share")
    return found.unionByName(cells.where("NOT tokens > 0").withColumn("share", F.lit(0.0))), error


def mix(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id",
        rate: float = 1.0, rounds: int = MAX_ROUNDS, tol: float = TOL, seed: int = SEED,
        temper: float = TEMPER, keep_all: bool = False, **cols) -> DataFrame:
    """The sampled rows of ``docs`` with ``_source, _lang, _topic, _tokens, weight,
    probability, sample_weight, margin_error``; ``keep_all`` returns every row and adds ``sampled``.
    ``targets`` is ``(dim, value, share)`` with ``dim`` in source, lang, topic."""
    if not rate > 0:
        raise ValueError("rate must be positive")
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ADDED]
    noted = annotate(docs.select(*kept), id_col, seed=seed, **cols)
    cells = stage(noted.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(
        F.sum("_tokens").alias("tokens")), "mix_base")
    raked, error = rake(cells, tempered_targets(cells, temper) if targets is None else targets, rounds, tol)
    whole = cells.agg(F.sum("tokens").cast("double")).scalar()
    weighed = raked.select(
        *[F.col(d).alias(f"_{d}") for d in DIMS],
        F.when(F.col("tokens") > 0, F.round(F.col("share") * whole / F.col("tokens"), 6))
        .otherwise(0.0).alias("weight"))
    weighed = weighed.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * rate))
    out = noted.join(weighed, [f"_{d}" for d in DIMS])
    drawn = (F.col("_u") < F.col("probability")) & (F.col("_tokens") > 0)
    out = out.withColumn("sample_weight", F.when(F.col("probability") > 0, F.col("weight") / F.col("probability")))
    out = out.withColumn("sampled", drawn) if keep_all else out.where(drawn)
    out = out.withColumn("margin_error", F.lit(float(error)))
    own = [*kept, *[f"_{d}" for d in DIMS], "_tokens", "weight", "probability", "sample_weight", "margin_error"]
    return out.select(*own, *(["sampled"] if keep_all else []))

"""Declared input schemas, and NOT NULL, range and UNIQUE enforced at the boundary.

``declared`` compares a table's columns with its schema before any job runs.  ``enforce``
divides the rows into those that meet the rules and a quarantine with the reason.  Nothing
is dropped: the good rows and the quarantine's ``copies`` add up to the input.

Equal rows are counted first, with map-side combine, so neither a row repeated millions of
times nor a NULL key (sent to quarantine before the key is looked at) gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


# Inputs of the curation (name, type, nullable).
SCHEMAS = {
    "scores": _schema(("score_id", _LONG, False), ("beatmap_id", _LONG, False), ("user_id", _LONG, False),
                      ("date", T.TimestampType(), False), ("enabled_mods", _INT, False),
                      *[(c, _LONG, False) for c in ("countgeki", "count300", "countkatu", "count100", "count50", "countmiss")]),
    "items": _schema(("beatmap_id", _LONG, False), ("playmode", _INT, False), ("diff_size", _INT, False),
                     ("difficultyrating", _DOUBLE, True)),
    "steps": _schema(("mid", _LONG, False), ("offset", _LONG, False), ("speed", _DOUBLE, False)),
    "item_scores": _schema(("sid", _LONG, False), ("mid", _LONG, False), ("speed", _INT, False), ("uid", _LONG, False),
                           ("year", _INT, False), ("accuracy", T.FloatType(), False)),
}
KEYS = {"scores": ["score_id"], "items": ["beatmap_id"], "steps": ["mid", "offset"], "item_scores": ["sid"]}


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns of ``df`` in its order; a missing column or another type is a
    ``TypeError`` that names all of them, raised before any job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, declared {f.dataType.simpleString()}"
             for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("columns differ from their declaration: " + "; ".join(wrong))
    return df.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def enforce(df: DataFrame, schema: T.StructType, key: list[str], ranges: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: rows without a NULL where none is declared, with values inside
    ``ranges`` (inclusive, None for an open end; NaN is outside), one for each key.

    Of the rows of one key the smallest in the order of the schema's columns is good.
    The quarantine has the schema's columns, ``copies`` (how many such rows) and ``reason``,
    the first of ``null <column>``, ``range <column>`` and ``key``."""
    rows = declared(df, schema)
    names = rows.columns
    found = [F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"null {f.name}")) for f in schema.fields if not f.nullable]
    for name, (low, high) in (ranges or {}).items():
        c = F.col(f"`{name}`")
        outside = F.lit(False)
        if isinstance(schema[name].dataType, (T.DoubleType, T.FloatType)):
            outside = F.isnan(c)
        if low is not None:
            outside = outside | (c < low)
        if high is not None:
            outside = outside | (c > high)
        found.append(F.when(outside, F.lit(f"range {name}")))
    reason = F.coalesce(*found) if found else F.lit(None).cast("string")
    judged = rows.withColumn("_reason", reason)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    good = (judged.where("_reason is null").groupBy(*[F.col(f"`{c}`") for c in key])
            .agg(F.min(row).alias("_first")).select(*[F.col("_first").getField(c).alias(c) for c in names]))
    counted = judged.groupBy(*[F.col(f"`{c}`") for c in names], "_reason").agg(F.count(F.lit(1)).alias("copies"))
    # The good row of a key is taken off its copies; a row that is not good keeps all of them.
    taken = good.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    same = F.col("_reason").isNull()
    for i, c in enumerate(names):
        # The key is an equality, so that the join is a hash or merge join; NULLs elsewhere are equal.
        mine, other = F.col(f"`{c}`"), F.col(f"_{i}")
        same = same & (mine == other if c in key else mine.eqNullSafe(other))
    left = counted.join(taken, same, "left").withColumn(
        "copies", F.col("copies") - F.when(F.col(f"_{names.index(key[0])}").isNotNull(), 1).otherwise(0))
    quarantine = left.where("copies > 0").select(
        *[F.col(f"`{c}`") for c in names], "copies", F.coalesce("_reason", F.lit("key")).alias("reason"))
    return good, quarantine

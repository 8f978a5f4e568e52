"""Factorisation machine and played bitmaps."""

import random

from pyspark.sql import functions as F

from oracle_check import compare, duck
from scorelens.operators import fm as FM
from scorelens.operators import played as PL
from scorelens.plans import registry

SF = "/root/testdata/sf0.001"


def test_fm_learns_a_planted_interaction(spark):
    rnd = random.Random(5)
    rows = [(f"{u}/2020", f"{m}/0", float((u % 5 - 2) * (m % 3 - 1)), "val" if rnd.random() < 0.2 else "train")
            for u in range(40) for m in range(30)]
    df = spark.createDataFrame(rows, "uid string, mid string, y double, part string").repartition(4)
    # 18 bits: no two of the ids collide (with 16, two users do and are half right)
    model = FM.fit(df.where("part = 'train'"), FM.FMConfig(bits=18, max_iter=60, reg=0.0))
    val = df.where("part = 'val'")
    mean = val.select("part", "y", F.lit(0.0).alias("pred"))
    table = {r.model: r for r in FM.compare({"fm": FM.predict(model, val), "mean": mean}).collect()}
    assert table["fm"].chosen and not table["mean"].chosen
    assert table["fm"].mse < 0.01 * table["mean"].mse
    assert table["fm"].n == table["fm"].finite == val.count()
    odd = spark.createDataFrame([(None, "1/0"), ("1/2020", None), ("999/2020", "1/0")], "uid string, mid string")
    assert [r.pred is None for r in FM.predict(model, odd).collect()] == [True, True, False]


def test_compare_counts_what_is_not_finite(spark):
    p = spark.createDataFrame([("val", 1.0, 1.5), ("val", 1.0, float("nan")), ("val", 2.0, None), ("val", 1.0, float("inf"))],
                              "part string, y double, pred double")
    r = FM.compare({"a": p, "b": p}).orderBy("model").collect()
    assert [(x.n, x.finite, x.mse, x.chosen) for x in r] == [(4, 1, 0.25, True), (4, 1, 0.25, False)]


def test_bitmaps_over_several_buckets(spark):
    rnd = random.Random(7)
    n_items = 2 * PL.BITS + 100
    codes = spark.range(n_items).selectExpr("concat('i', id) AS label", "id AS code")
    edges = [0, 7, 8, PL.BITS - 1, PL.BITS, 2 * PL.BITS - 1, 2 * PL.BITS, n_items - 1]
    plays = {(f"u{u}", m) for u in range(4) for m in edges[:3 + u] + [rnd.randrange(n_items) for _ in range(40)]}
    rows = [(u, f"i{m}") for u, m in plays]
    half = len(rows) // 2
    schema = "uid string, mid string"
    a, b = (spark.createDataFrame(x, schema) for x in (rows[:half] * 2, [*rows[half:], (None, "i1"), ("u0", None), ("u0", "gone")]))
    maps = PL.merge(PL.bitmaps(a, codes), PL.bitmaps(b, codes))
    want = {}
    for u, m in plays:
        want[u, m // PL.BITS + 1] = want.get((u, m // PL.BITS + 1), 0) + 1
    size = {1: PL.BITS, 2: PL.BITS, 3: 100}
    got = {(r.uid, r.bucket): (r.n_played, r.n_unplayed) for r in PL.counts(maps, codes).collect()}
    assert got == {k: (n, size[k[1]] - n) for k, n in want.items()}
    asked = [(f"u{u}", f"i{m}") for u in range(5) for m in edges + [1, 9, PL.BITS + 1]] + [("u0", "gone"), ("u0", None), (None, "i0")]
    known = {(u, f"i{m}") for u, m in plays}
    for r in PL.is_played(spark.createDataFrame(asked, schema), maps, codes).collect():
        assert r.played == (None if r.mid in ("gone", None) else (r.uid, r.mid) in known)


def test_queries_are_their_sql(spark):
    for name in ("model_choice_summary", "unplayed_buckets", "played_next"):
        df = registry.queries()[name](spark, SF)
        res = duck(SF).execute(registry.oracle_sql()[name])
        same, a, b = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [c[0] for c in res.description])
        assert same and a, name


def test_played_bitmaps_hold_one_word_per_touched_word(spark):
    """A bitmap's row has a fixed width: no 4 KB per user and bucket in sorts and shuffles."""
    codes = spark.range(3 * PL.BITS).selectExpr("concat('i', id) AS label", "id AS code")
    plays = spark.createDataFrame([("a", f"i{m}") for m in (0, 63, 63, 64, PL.BITS + 63, 3 * PL.BITS - 1)], "uid string, mid string")
    maps = PL.bitmaps(plays, codes)
    assert dict(maps.dtypes)["bits"] == "bigint"
    assert {(r.bucket, r.word): r.bits & (2 ** 64 - 1) for r in maps.collect()} == {
        (1, 0): 1 + 2 ** 63, (1, 1): 1, (2, 0): 2 ** 63, (3, PL.BITS // PL.WORD - 1): 2 ** 63}

"""Hard negatives against plain loops; the residue products against whole numbers."""

import numpy as np
import pytest

from scorelens.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=420, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.5, (10, dims))
    rows = [(i, (centre[i % 5] + rng.normal(0, 0.3, dims)).round(2).tolist(), int(i % 5)) for i in range(n)]
    rows += rows[90:110] + [(1000, [], 1), (None, rows[3][1], 2), (None, rows[3][1], 2), (1200, None, 1), (1300, [0.5], None),
                            (1400, [float("nan")] * dims, 1), (1500, [None] * dims, 1), (1600, [float("inf")] * dims, 1),
                            (1700, [0.5] * (dims + 3), 1), (-200, [0.1] * (dims - 2), 9), (300, rows[300][1], 4)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("parts, batch", [(1, 1 << 20), (7, 8 * 15 * 3)])
def test_equals_plain_loops(spark, monkeypatch, parts, batch):
    """Also with several batches of anchors; ties, copies, nulls and unequal lengths."""
    monkeypatch.setattr(N, "PAIRS", 700)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS row", "2 AS score").repartition(parts)
    got = [tuple(r) for r in N.hard_negatives(df, batch_bytes=batch).collect()]
    want = N.brute_force(rows)
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.hard_negatives(df).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    out = N.hard_negatives(one)
    assert out.count() == 0 and dict(out.dtypes)["rank"] == "int"


@pytest.mark.parametrize("most, width", [(1, 1), (159, 64), (5000, 200), (1 << 21, 64)])
def test_products_are_exact(most, width):
    rng = np.random.default_rng(most)
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (9, 33))
    a[0] = b[0] = most
    b[1] = -most
    moduli = N.primes(width * most ** 2)
    assert (N.products(a, b, moduli) == a @ b.T).all()
    assert all(N.DIMS * (p // 2) ** 2 < 1 << 24 for p in moduli) and len(set(moduli)) == len(moduli)


def test_scores_that_do_not_fit(spark):
    df = spark.createDataFrame([(100, [1e12], 1), (1, [2.0], 1)], SCHEMA)
    with pytest.raises(OverflowError):
        N.hard_negatives(df)

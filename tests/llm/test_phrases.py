"""Phrase collocations against counting every phrase in dictionaries."""

import random

import numpy as np
import pytest

from llm import edge
from scorelens.llm import collocations as P

SCHEMA = "lang string, text string"


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "x\x00y"]

    def text():
        return "".join(rnd.choice(words) + rnd.choice([" "] * 12 + [", ", ".\n", "  ", "\t"]) for _ in range(rnd.randint(0, 300)))

    rows = [(rnd.choice(["en", "en", "de", None]), text()) for _ in range(120)]
    return rows + [("en", None), ("fr", ""), ("und", "w1 w2 w3")] + [("en", "alpha beta Gamma delta eps zeta eta theta")] * 40


@pytest.mark.parametrize("top, first, cover", [(2000, None, 80), (5, 6, 80), (3, 1, 50)])
def test_equals_counting_everything(spark, top, first, cover):
    """Also where the frontier is opened in several rounds (``first`` small)."""
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in P.collocations(df, top=top, first=first, cover=cover).collect())
    assert got == P.brute_force(rows, top=top, cover=cover) and got


def test_phrase_edges(spark):
    rows = [(r[2], r[1]) for r in edge.rows()] * 20
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA + ", f int, u1 string")
    assert sorted(tuple(r) for r in P.collocations(df).collect()) == P.brute_force(rows)
    assert P.collocations(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        P.collocations(df, top=0)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(6 * 10 ** 15, 7 * 10 ** 15, 6 * 10 ** 15)], "f long, l long, r long")
    assert df.select(P.points("f", "l", "r")).first()[0] == 2_000_000 * 6 // 13


def test_segments_cut_long_texts_between_pieces(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(P, "SEGMENT", 16)
    texts = ["", "a b c, d e f. g h i! " * 9, "one", "", "no break at all in this long text of words", "Z z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    found = [raw[a:b] for raw, _, (_, _, start, end, _) in P._read([batch]) for a, b in zip(start, end)]
    assert found == [w for t in texts for w in P.re.findall(rb"[^ \t.,;:!?]+", t.lower().encode())]
    pieces = sum(len(set(np.unique(p).tolist())) for _, _, (_, p, *_) in P._read([batch]))
    assert pieces == 9 * 3 + 1 + 1 + 1


def test_bitmap_agrees_with_the_tasks(spark):
    rng = np.random.default_rng(0)
    u = rng.integers(-(1 << 63), 1 << 63, (50, 4), dtype=np.int64)
    df = spark.createDataFrame(u.tolist(), "u1 long, u2 long, u3 long, u4 long")
    for m in (1, 2, 3, 4):
        names = [f"u{i + 1}" for i in range(m)]
        bits = np.frombuffer(P.bitmap(df, names), dtype=np.uint8)
        at = np.unique(P._fold([u[:, i].view(np.uint64) for i in range(m)]) >> np.uint64(64 - P.BITS)).astype(np.int64)
        assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == at.tolist()

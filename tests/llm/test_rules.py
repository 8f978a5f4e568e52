"""Quality rules: base figures by plain loops, the cascade's verdict in any order."""

import itertools
import re
from collections import Counter

import pytest

from llm import edge
from scorelens.llm import quality_rules as R
from scorelens.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_query_is_its_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op13_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == plain(docs[r.doc_id])
        assert r.kept == (not r.base_failed and not any(f(R.Doc(docs[r.doc_id])) for f in R.RULES.values()))
    assert {r.kept for r in rows} == {True, False}


CASES = [None, "", " \n ", "a b c " * 3, "a b c d e f g h " * 2, "a b c d e f g a b c d e f g a", "x\ny\nx\n \n \nx ",
         "one two three four five six seven eight nine one two three four five six seven eight", "É中 #|<>&%$* \x0b\x0c é",
         "w " * 50, "\n".join(["same line here"] * 9), " ".join(f"w{i}" for i in range(40))]


@pytest.mark.parametrize("text", CASES)
def test_base_figures(text):
    d = R.Doc(text)
    assert (len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) == plain(text)


def test_equal_hashes_of_windows_are_compared(monkeypatch):
    monkeypatch.setattr(R, "mix64", lambda h: h * 0)
    for text in CASES:
        assert R.Doc(text).n_repeat_words == plain(text)[4]


@pytest.mark.parametrize("rule, bad", [
    ("word_length", "a b " * 20), ("symbols", "wort# " * 30), ("dup_lines", "one two\n" * 9), ("capitals", "SHOUT now " * 20),
    ("exclamations", "hey!! you " * 20), ("letters", "12 345 word " * 20), ("insults", "good text here idiot, you Stupid### one " * 5)])
def test_rules(rule, bad):
    good = "\n".join(f"Some ordinary words of a sentence number {i}, with US and a mark!" for i in range(9))
    assert R.RULES[rule](R.Doc(bad)) and not R.RULES[rule](R.Doc(good))


def test_cascade_order_and_short_circuit(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text + (" ##### |||||" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    verdicts = set()
    for order in itertools.islice(itertools.permutations(R.RULES), 0, 5040, 1009):
        rows = R.judge(docs, order=list(order)).collect()
        verdicts.add(tuple(sorted((r.doc_id, r.kept) for r in rows)))
        assert all(r.n_rules == (order.index("symbols") + 1 if r.doc_id % 2 else 7) for r in rows)
    assert len(verdicts) == 1
    stats = [dict(rule=k, n=100, rejected=x, ns=y) for k, x, y in (("a", 50, 1000), ("b", 50, 100), ("c", 1, 100), ("d", 0, 0))]
    assert R.order_of(stats, dict.fromkeys("abcde")) == ["b", "a", "c", "d", "e"]
    assert R.order_of([], R.RULES) == list(R.RULES)
    found = {r.rule: r for r in R.estimate(docs, every=1).collect()}
    assert found["symbols"].n == 40 and found["symbols"].rejected == 20 and found["capitals"].rejected == 0
    assert all(r.ns > 0 for r in found.values())


def test_rule_edges(spark):
    clash = edge.docs(spark, extra=True).selectExpr("*", "'k' AS kept", "1.5 AS n_words", "'t' AS __text2")
    rows = R.judge(clash).collect()
    assert len(rows) == len(edge.rows()) and sorted(r.n_words for r in rows) == sorted(plain(r[1])[0] for r in edge.rows())
    assert {r.base_failed for r in rows} == {True} and {r.failed for r in rows} == {"base"}
    assert R.judge(edge.empty(spark)).count() == 0

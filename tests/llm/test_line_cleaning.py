"""Measures against a recount, and which lines go."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrascope.llm import line_cleaning as lc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def recount(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


CASES = [
    "a b c a b c", "a b c a b c a b", "x x x x", "x x x", "a b\na b\n\n  \na b", "one  two\t\x0bthree\r\nfour", "# * $ % & | < >", "é 漢 é 漢 é 漢", "    x", " ", "\n\n",
    "a b c d " * 300, "p q r " + "s " * 60 + "p q r",
]


def test_measures(spark, odd, odd_rows):
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").select("doc_id", "text").union(odd.select("doc_id", "text"))
    for r in rows.select("text", lc.measures(F.col("text")).alias("m")).collect():
        assert tuple(r.m) == recount(r.text), r.text and r.text[:60]


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence ends here.", False), ("He said \"no.\"", False), ("Home", True), ("Home | About | Contact | News", True), ("Read all about it", True),
        ("All rights reserved.", True), ("Click here to subscribe.", True), ("Wait!!!  ", False), ("1234 5678", True),
        ("This long line talks of many things. It has no end but it is clearly prose that goes on", False),
    ],
)
def test_lines(spark, line, fails):
    got = spark.createDataFrame([(line,)], "text string").select(lc.cleaned(F.col("text")).alias("c")).first().c
    assert (got.n_bad_lines == 1) == fails and got.text == ("" if fails else line)


def test_documents(spark, odd, odd_rows, empty):
    prose = "\n".join(f"Line{i} has word{i * 7} and thing{i * 3} near place{i} with some{i} other{i}." for i in range(10))
    menu = "\n".join(f"Item{i} | Go{i} | Buy{i} | {i}" for i in range(40))
    rows = [(1, prose), (2, prose + "\n" + menu), (3, menu), (4, "Too short."), (5, "again and again. " * 40), (6, prose + "\nHome")]
    got = {r.doc_id: r for r in lc.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert {i for i, r in got.items() if r.base_failed} == {4, 5}
    assert got[6].clean_text == prose and got[6].n_bad_lines == 1
    assert lc.clean_lines(odd).count() == len(odd_rows) and lc.clean_lines(empty).count() == 0

"""Spans of planted notices; alignment and index on hand-made cases."""

import random

import pytest

from terrascope.llm import license_spans as ls


@pytest.fixture(scope="module")
def index():
    return ls.Index(ls.TEMPLATES)


def test_every_run_of_words_hits_the_index(index):
    for t, row in enumerate(index.rows):
        size = ls.K + ls.WINNOW - 1
        starts = {i for places in index.places.values() for u, i in places if u == t}
        for at in range(max(1, len(row) - size + 1)):
            assert any(at <= i <= at + ls.WINNOW - 1 for i in starts), index.names[t]


def test_exact_and_altered_notices(index):
    mit = ls.TEMPLATES["MIT-text"]
    words = mit.split()
    altered = " ".join(words[:9] + ["slightly", "other"] + words[10:])  # two words for one
    for notice, least in ((mit, 1.0), (altered, 0.9)):
        text = f"Ünrelated text, here. {notice}\nand more"
        ((name, start, end, coverage),) = ls.matches(text.encode(), index, 0.8)
        assert name == "MIT-text" and coverage >= least
        assert text[start:end].startswith("Permission is") and text[start:end].endswith("without restriction")
    assert ls.matches(" ".join(words[: len(words) // 2]).encode(), index, 0.8) == []


SIBLINGS = {
    "Released under the BSD License": "", "Released under the Frobnicate License": "", "Released under the MIT-0 License": "",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC 3.0": "",
    "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0-title",
    "licensed under a Creative Commons Attribution 3.0 International License": "",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2.0", "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "This work is licensed under the GNU General Public License, version 1": "", "Licensed under the Apache License, Version 1.1": "",
}


def test_siblings_are_told_apart(index):
    gpl = ls.TEMPLATES["GPL-3.0-header"]
    more = {gpl.replace("version 3", "version 2"): "GPL-2.0-header", gpl.replace("version 3", "version 1"): "", gpl.replace("GNU General", "GNU Affero General"): "AGPL-3.0-header"}
    more |= {ls.TEMPLATES[n]: n for n in ls.TEMPLATES}
    for notice, name in (SIBLINGS | more).items():
        got = ls.matches(f"Some words before. {notice} and after.".encode(), index, ls.COVERAGE)
        assert [m[0] for m in got] == [name] * bool(name), notice


def test_alignment_against_full_table():
    """Within a wide band the banded alignment reaches the score of the whole table."""
    rng = random.Random(3)

    def whole(a, b):
        best, above = 0, [0] * (len(b) + 1)
        for x in a:
            here = [0]
            for j, y in enumerate(b, 1):
                here.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, here[-1] - 1))
            best, above = max(best, *here), here
        return best

    for _ in range(40):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 7))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(1, 7))]
        matched, first, last = ls.align(a, b, 0)
        # So many matches score at most twice their number, and no word matches twice.
        assert 2 * matched >= whole(a, b) and matched <= min(len(a), last - first + 1)


def test_scan(spark, odd, odd_rows, empty):
    notices = list(ls.TEMPLATES.items())
    rows = [(i, f"Some words before {t} and after.") for i, (_, t) in enumerate(notices)] + [(99, "Released under the MIT License. " * 3)]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(notices):
        assert name in got[i].licenses.split(","), name
    assert got[99].n_matches == 3
    assert ls.scan(odd).where("n_matches = 0").count() == len(odd_rows)
    assert ls.scan(empty).count() == 0

"""Components against all pairs."""

import random
import re

import numpy as np
import pytest

from terrascope.llm import circulant_minhash as cm
from terrascope.llm.common import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def all_pairs(rows, width, percent):
    """Shingle count and smallest id of the component of every row."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    for a, (i, _) in enumerate(rows):
        ids = [j for b, (j, _) in enumerate(rows) if root(b) == root(a) and j is not None]
        yield len(sets[a]), min(ids, default=None) if sets[a] else i


def corpus():
    """Chains of edits, crowds of near copies, exact copies, and pairs just under and over the threshold."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(60)]
    for start in range(6):  # chains: each differs from the one before, the ends are far apart
        words = texts[start].split()
        for _ in range(12):
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    base = [word() for _ in range(200)]
    for _ in range(150):  # a crowd whose members are each a few words from the base
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    texts += [texts[10]] * 40 + [texts[11].upper().replace(" ", "\n  ")] * 3 + ["hi", "HI", "hi there", "hi\tthere", "", " \n", None, "ß x"]
    return [(7 * i + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components(spark, width, percent):
    rows = corpus()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, digest string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in cm.near_duplicates(table, width, percent).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, least) in zip(rows, all_pairs(rows, width, percent)):
        assert got[i] == (n, least, i == least)


def test_crowds(spark, monkeypatch):
    """Crowds whose members lie under, at and over the threshold, the last turn left to the prefix filter."""
    monkeypatch.setattr(cm, "FEW", -1)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = corpus()
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([2, 5, 6, 12])):
            words[rng.randrange(150)] = word()
        rows.append((10_000 + k, " ".join(words)))
        rows.append((20_000 + k, " ".join(passage + [word() for _ in range(rng.choice([5, 10, 40]))])))
    for shrink in (0.7, -1):
        monkeypatch.setattr(cm, "SHRINK", shrink)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
        assert [got[i] for i, _ in rows] == list(all_pairs(rows, 3, 85))


def test_odd_rows(odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = sorted((repr((r.doc_id, r.n_shingles, r.component_id)) for r in cm.near_duplicates(odd, 3, 85).collect()))
    assert got == sorted(repr((i, n, c)) for (i, _), (n, c) in zip(rows, all_pairs(rows, 3, 85)))
    out = cm.keep_one(odd)
    assert out.columns == odd.columns and out.count() < len(odd_rows)
    assert cm.near_duplicates(empty).count() == 0 and cm.keep_one(empty).count() == 0


def test_shifted_permutations():
    """Each coordinate agrees about as often as the sets are similar."""
    rng = np.random.default_rng(2)
    assert len(set(cm._permute32(np.arange(100_000, dtype=np.uint32), 0x9E3779B1).tolist())) == 100_000
    agree = []
    for _ in range(30):
        both, rest = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.concatenate([both, rest[:200]]), np.concatenate([both, rest[200:]])
        agree.append(np.mean(cm.band_keys(np.unique(a), 128, 1) == cm.band_keys(np.unique(b), 128, 1)))
    assert np.mean(agree) == pytest.approx(800 / 1200, abs=0.03)
    assert cm.bands_needed(85) >= 22


def test_components_of_long_chain(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(120)] + [("900", "901"), ("901", "900"), ("950", "950")]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(121)} | {"900": "900", "901": "900"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0

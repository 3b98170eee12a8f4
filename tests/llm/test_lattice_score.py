"""Word probabilities against enumeration of all segmentations; counts against a recount."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from terrascope.llm import lattice_score as ls


class Toy:
    """Five pieces and the bytes."""

    def __init__(self):
        self.number = {"▁": 256, "▁a": 257, "a": 258, "b": 259, "ab": 260, "▁ab": 261}
        self.byte = {b: b for b in range(256)}
        self.end = 262


def segmentations(text, pieces):
    if not text:
        yield []
    for size in range(1, len(text) + 1):
        if text[:size] in pieces:
            for rest in segmentations(text[size:], pieces):
                yield [text[:size], *rest]


@pytest.mark.parametrize("word", ["", "a", "ab", "abab", "bbbaab", "ab" * 6])
def test_forward_adds_up_all_segmentations(word):
    toy = Toy()
    logs = np.log(np.random.default_rng(8).dirichlet(np.ones(263)))
    total = sum(math.exp(sum(logs[toy.number[p]] for p in s)) for s in segmentations("▁" + word, toy.number))
    assert ls.Lattice(toy, logs).log_words([word, "b", word])[2] == pytest.approx(math.log(total), rel=1e-9)


def test_bytes_and_long_words():
    toy = Toy()
    logs = np.log(np.full(263, 1 / 263))
    assert ls.Lattice(toy, logs).log_words(["é"])[0] == pytest.approx(3 * math.log(1 / 263))
    long = ls.Lattice(toy, logs).log_words(["ab" * 20_000])[0]
    assert math.isfinite(long) and long < -1000


def recount(rows):
    tokens = [(i, t.encode().lower().split() + [None] if t else [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        yield i, held(i), len(words), sum(counts[w] > 0 for w in words), n, base


def test_odd_rows(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK", 4000)  # several blocks
    got = ls.score(odd).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got], key=key)
    expected = list(recount([(r[0], r[1]) for r in odd_rows]))
    assert mine == sorted([e[:5] for e in expected], key=key)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(e[5] for e in expected), rel=1e-9)
    empty_text = next(r for r in got if r.doc_id == 20)
    assert all(r.score <= empty_text.score + 1e-9 for r in got)
    assert ls.score(empty).count() == 0


def test_score_is_the_sum_of_its_words(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the dog", "Cat cat", "überall 漢字", ""])]
    got = {r.doc_id: r.score for r in ls.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pieces = ls._pieces(None)
    counts = np.zeros(max(pieces.size, pieces.end + 1))
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts[pieces.end] += 1
            for piece, n in pieces.count([w.decode() for w in t.encode().lower().split()], [1] * len(t.split())).items():
                counts[piece] += n
    lattice, logs = ls.Lattice(pieces, ls.piece_logs(counts)), ls.piece_logs(counts)
    for i, t in rows:
        total = logs[pieces.end] + sum(lattice.log_words([w.decode() for w in t.encode().lower().split()]))
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-9)

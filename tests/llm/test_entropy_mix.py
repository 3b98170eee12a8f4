"""Targets against a replay of the resharing rule, and what the mix takes."""

import random
from collections import defaultdict

import pytest

from terrascope.llm import entropy_mix as em


def reshared(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        mass = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and rest * weight[s] / mass > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else rest * weight[s] / mass for s in names}
        full |= above


@pytest.fixture(scope="module")
def corpus(spark):
    """Eight sources, one of which holds a third of all documents, many of them copies."""
    random.seed(2)
    rows = [(i, " ".join(["w"] * int(random.paretovariate(1.1) * 6)), None if i % 9 == 8 else f"ß{i % 7}") for i in range(1500)]
    rows += [(2000 + i, "a b c d e", "hot") for i in range(1100)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_and_taken(corpus):
    table, rows = corpus
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    wanted = reshared(sizes)
    got = em.mix(table).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(rows_text(rows)[r.doc_id].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size and abs(r.copies - r.rate) <= 2
        taken[r.source] += r.taken
    for source, target in wanted.items():
        assert taken[source] == pytest.approx(target, abs=max(60, 0.002 * target)), source


def rows_text(rows, held={}):
    if not held:
        held.update({i: t for i, t, _ in rows})
    return held


def test_rates_are_tilted_by_size(spark):
    """Within a source the logarithm of the rate is linear in the size, below the cap."""
    import math

    counts = spark.createDataFrame([("=a", n, 1 + n % 3) for n in range(1, 60)], "grp string, size long, n long")
    total = sum(n * (1 + n % 3) for n in range(1, 60))
    targets = spark.createDataFrame([("=a", "a", total, 0.4 * total)], "grp string, source string, source_size long, target double")
    solved = em.tilts(counts, targets, tolerance=1e-10).first()
    rate = lambda n: min(2.0, math.exp(solved.tilt * n / solved.scale))
    assert sum(n * (1 + n % 3) * rate(n) for n in range(1, 60)) == pytest.approx(0.4 * total, rel=1e-8)
    assert solved.tilt < 0


def test_reruns_agree_for_any_partitioning(corpus):
    table, _ = corpus
    take = lambda df: sorted((r.doc_id, r.taken) for r in em.mix(df).select("doc_id", "taken").collect())
    assert take(table) == take(table.repartition(11))


def test_odd_rows(odd, odd_rows, empty):
    got = em.mix(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.taken <= 2 * r.size and (r.size > 0 or r.taken == 0) and r.target is not None
    assert em.mix(empty).count() == 0


def test_repeated_documents(corpus, odd, empty):
    table, _ = corpus
    copies = {r.doc_id: r.copies for r in em.mix(table).collect()}
    seen = defaultdict(int)
    for r in em.repeated(table).collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == seen
    out = em.repeated(odd)
    assert out.columns == odd.columns and out.where("doc_id = 20").count() == 1
    assert em.repeated(empty).count() == 0

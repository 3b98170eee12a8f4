"""Neighbours against brute force."""

import numpy as np
import pytest

from terrascope.llm import kmeans_tree as kt


def exact(ids, rows, k, step):
    for i, q in zip(ids, rows):
        if i % step == 0:
            scores = rows @ q
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            yield i, [(int(ids[j]), float(scores[j])) for j in order]


@pytest.fixture(scope="module")
def vectors():
    """Clusters of unequal norms; a third of all rows are one vector."""
    rng = np.random.default_rng(41)
    centres = rng.normal(size=(12, 16))
    rows = centres[rng.integers(0, 12, 1600)] + 0.4 * rng.normal(size=(1600, 16))
    rows *= rng.uniform(0.3, 2, (1600, 1))
    rows = np.vstack([rows, np.repeat(rows[:1], 800, 0)]).astype(np.float32)
    return np.arange(1, 2401) * 3, rows


def test_recall_and_scores(spark, vectors):
    ids, rows = vectors
    table = spark.createDataFrame([(int(i), r.tolist(), "x", 0) for i, r in zip(ids, rows)], "vec_id long, embedding array<float>, rep string, leaf int")
    got = {}
    for r in kt.search(table.repartition(5)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for query, best in exact(ids, rows.astype(np.float64), 20, 20):
        mine = sorted(got.pop(query))
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(v != query for _, v, _ in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        at = {int(i): n for n, i in enumerate(ids)}
        q = rows[at[query]].astype(np.float64)
        assert all(s == pytest.approx(float(rows[at[v]].astype(np.float64) @ q), rel=1e-12) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in best})
        total += len(best)
    assert not got and hits >= 0.9 * total


def test_small_and_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (40, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in kt.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 2.0), (0, 2, 5, 0.5), (0, 3, 20, 0.5), (20, 1, 6, 1.5), (20, 2, 0, 0.5), (20, 3, 5, 0.5)]
    assert kt.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_rows_count_once(spark):
    """Queries and candidates given twice: every neighbour still comes once, and k different ones come."""
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=8).tolist() for i in range(1, 121)}
    given = [*rows.items(), *[(i, rows[i]) for i in (20, 20, 40, 7, 7, 7)], (9, [100.0] * 8)]
    table = spark.createDataFrame([(i, e) for i, e in given], "vec_id long, embedding array<double>")
    rows[9] = min(rows[9], [100.0] * 8)
    ids, matrix = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got = {}
    for r in kt.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    best = {int(i): {v for v, _ in found} for i, found in exact(ids, matrix, 20, 20)}
    assert got.keys() == best.keys() and all(len(v) == len(set(v)) == 20 and i not in v for i, v in got.items())
    assert sum(len(best[i] & set(v)) for i, v in got.items()) >= 0.9 * 20 * len(best)


def test_tree_ranks_every_leaf_once():
    rows = np.random.default_rng(1).normal(size=(3000, 8))
    tree = kt.Tree(rows)
    near = ((tree.centres - rows[5]) ** 2).sum(1).tolist()
    assert sorted(tree.ranked(near, tree.leaves)) == list(range(tree.leaves)) and tree.leaves > 20
    assert tree.ranked(near, 3) == tree.ranked(near, 9)[:3]
    assert set(tree.place(rows)) <= set(range(tree.leaves))


def test_wanted_leaves_hold_the_first_ranked():
    rows = np.random.default_rng(2).normal(size=(3000, 8))
    tree = kt.Tree(rows)
    near = ((tree.centres[None] - rows[:40, None]) ** 2).sum(2)
    for most in (1, 7, tree.leaves):
        wanted = tree.wanted(near, most)
        for want, distances in zip(wanted, near.tolist()):
            # The best-first search takes the very same leaves, as many as come along with the last one.
            assert set(tree.ranked(distances, most)) <= set(np.flatnonzero(want)) == set(tree.ranked(distances, int(want.sum())))


def python_rows(spark, run):
    """Most rows that any Python step of the queries started by ``run`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = [0]
    executions = store.executionsList().drop(seen).iterator()
    while executions.hasNext():
        execution = executions.next().executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while node.name() == "MapInArrow" and metrics.hasNext():
                metric = metrics.next()
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return max(rows)


def test_rows_grow_with_the_table(spark, monkeypatch):
    """Vectors without structure, so that a query wants most leaves: four times the rows must not send sixteen times the copies."""
    monkeypatch.setattr(kt, "LEAF", 4)
    made = []
    for n in (1500, 6000):
        rows = np.random.default_rng(n).normal(size=(n, 24))
        table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
        made.append(python_rows(spark, lambda: kt.search(table).collect()))
    assert 0 < made[1] <= 6 * made[0]

"""Brute-force twins of the operators with an own formulation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.operators import embeddings as em
from terrascope.operators import geometry as ge
from terrascope.operators import ordered as od
from terrascope.operators import stateful as sf


def test_temporal_support_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    clouds = {f: rng.uniform(0, 1, (60, 3)) for f in range(8)}
    clouds[3] = np.vstack([clouds[3], np.full((200, 3), 0.5) + rng.normal(0, 0.01, (200, 3))])  # one crowded place
    clouds[4] = np.vstack([clouds[4], np.full((200, 3), 0.5) + rng.normal(0, 0.01, (200, 3))])
    rows = [(f, i, *map(float, p)) for f, c in clouds.items() for i, p in enumerate(c)]
    table = spark.createDataFrame(rows, "frame_index int, point_idx bigint, x double, y double, z double")
    got = {(r.frame_index, r.point_idx): (r.support, r.kept) for r in ge.temporal_support(table, 0.12, 3, 3, 2).collect()}
    for f, cloud in clouds.items():
        window = [g for g in range(max(0, f - 3), min(7, f + 3) + 1)]
        for i, p in enumerate(cloud):
            near = {g for g in window if g != f and (((clouds[g] - p) ** 2).sum(1) <= 0.12**2).any()}
            both = f - 2 >= window[0] and f + 2 <= window[-1]
            kept = 1 + len(near) >= min(3, len(window)) and (not both or (any(g <= f - 2 for g in near) and any(g >= f + 2 for g in near)))
            assert got[f, i] == (1 + len(near), kept)


def test_nearest_z_replays_the_float_buffer(spark):
    rng = np.random.default_rng(1)
    z = np.repeat(rng.uniform(1, 2, 40), 5) + rng.integers(-2, 3, 200) * 1e-9
    rows = [(0, int(i % 7), 0, int(i), float(d)) for i, d in enumerate(z)]
    table = spark.createDataFrame(rows, "frame_index int, u int, v int, point_idx bigint, zc double").repartition(5)
    got = {r.u: (r.point_idx, r.depth) for r in ge.nearest_z_pixel(table, []).collect()}
    for pixel in range(7):
        best, winner = np.float32(np.finfo(np.float32).max), -1
        for _, u, _, i, d in rows:
            if u == pixel and d < float(best):
                best, winner = np.float32(d), i
        assert got[pixel] == (winner, float(best))


def test_bucketed_order_equals_plain_order(spark):
    rows = [(k, (i * 37) % 101, i) for k in range(2) for i in range(300)]
    table = spark.createDataFrame(rows, "k int, t bigint, v bigint").withColumn("b", F.floor(F.col("t") / 10))
    order = [F.col("t"), F.col("v")]
    got = od.with_positions(table, ["k"], "b", order).collect()
    for k in range(2):
        assert [r.position for r in sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.v))] == list(range(300))
    before = od.with_previous(table, ["k"], "b", order, "v", "prev").collect()
    ordered = sorted((r for r in before if r.k == 1), key=lambda r: (r.t, r.v))
    assert [r.prev for r in ordered] == [None] + [r.v for r in ordered[:-1]]
    cut = od.exact_percentiles(table, ["k"], "t", {"q": 0.37}, F.floor(F.col("_value") / 7)).first()
    assert cut.q == pytest.approx(np.quantile([r[1] for r in rows if r[0] == 0], 0.37))


def replay(observations, alpha, scale, bound):
    label = strength = pending = support = 0
    for target, conf in observations:
        if abs(strength) <= 1e-6 or label == target:
            label, strength, pending, support = target, (1 - alpha) * strength + alpha * conf * scale, 0, 0
            continue
        support = support + conf if pending == target else conf
        pending = target
        if support >= bound:
            label, strength, pending, support = target, conf * scale, 0, 0
    return label, strength, pending, support


@pytest.mark.parametrize("stickiness", [0.2, 0.8])
def test_switch_state_equals_replay_for_a_dominant_point(spark, stickiness):
    rng = np.random.default_rng(int(stickiness * 10))
    streams, rows = {}, []
    for point, size in ((0, 900), (1, 40), (2, 1)):
        target, seen = 1, []
        for i in range(size):
            target = target if rng.random() < stickiness else int(rng.integers(1, 5))
            seen.append((target, float(rng.uniform(0.05, 1.0))))
            rows.append((point, i, i * 3600, *seen[-1]))
        streams[point] = seen
    table = spark.createDataFrame(rows, "point_id bigint, seq bigint, s bigint, target int, conf double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.point_id: r for r in sf.observation_switch(table, 6, 0.3, 4.0, 1.5).collect()}
    for point, seen in streams.items():
        label, strength, pending, support = replay(seen, 0.3, 4.0, 1.5)
        r = got[point]
        assert (r.label, r.pending_label) == (label, pending)
        assert r.strength == pytest.approx(strength) and r.pending_support == pytest.approx(support)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, feature array<double>")
    return x, table.repartition(5).cache()


def test_covariance_and_basis(vectors):
    x, table = vectors
    cov = em.covariance(em.weighted_moments(table))
    got = np.zeros((12, 12))
    for r in cov.collect():
        got[r.i, r.j] = r.cov
    assert np.allclose(got, np.cov(x.T))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert em.fit_basis(cov, 4).explained == pytest.approx(values[:4].sum() / values.sum())


def test_codebook(vectors):
    x, table = vectors
    centers = em.codebook_kmeans(table, "id", 6, 4, 11)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1) and np.allclose(centers, em.codebook_kmeans(table, "id", 6, 4, 11))
    quality = em.codebook_quality(table, centers).first()
    best = (x @ centers.T).max(1)
    assert quality.top1_cosine_mean == pytest.approx(best.mean()) and quality.top1_cosine_p05 == pytest.approx(np.quantile(best, 0.05))
    expected = []
    for row in x:
        chosen = centers[np.argsort(-(centers @ row))[:4]]
        mix = np.linalg.solve(chosen @ chosen.T + 1e-4 * np.eye(4), chosen @ row) @ chosen
        expected.append(row @ mix / np.linalg.norm(mix))
    got = em.codebook_topk_ls(table, centers).first()
    assert got.topk_cosine_mean == pytest.approx(np.mean(expected)) and got.topk_cosine_p05 == pytest.approx(np.quantile(expected, 0.05))


def test_top_sets_with_many_equal_scores(spark):
    rows = [(f, r, 1, [0.9, 0.5, 0.5][r % 3], ((r * 7) % 10) / 10.0) for f in range(2) for r in range(45 + f)]
    table = spark.createDataFrame(rows, "frame_index int, region int, query_id bigint, full double, compact double")
    got = em.topset_jaccard(table, 0.4).first()
    shares = []
    for f in range(2):
        mine = [r for r in rows if r[0] == f]
        size = max(1, int(np.ceil(0.4 * len(mine))))
        a, b = ({r[1] for r in sorted(mine, key=lambda r: (-r[c], r[1]))[:size]} for c in (3, 4))
        shares.append(len(a & b) / len(a | b))
    assert got.frame_mean_jaccard == pytest.approx(np.mean(shares)) and got.frames == 2


def test_small_tables_are_bounded(vectors):
    with pytest.raises(ValueError, match="more than 10 rows"):
        em.bounded_rows(vectors[1], 10)

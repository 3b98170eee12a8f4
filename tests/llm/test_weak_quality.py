"""Recovered accuracies, held-out labels of the table, and odd rows."""

import numpy as np
import pyarrow as pa

from terrascope.llm import weak_quality as wq

FOLDER = "/root/testdata/sf0.01"


def test_em_recovers_voters():
    """Votes drawn from known chances: shares and chances come back."""
    rng = np.random.default_rng(6)
    n, good = 60_000, rng.random(60_000) < 0.85
    chance = np.empty((len(wq.VOTERS), 2, 3))
    for k in range(len(wq.VOTERS)):
        chance[k, 1] = [0.2, 0.02 + 0.01 * k, 0.78 - 0.01 * k]
        chance[k, 0] = [0.2, 0.55 - 0.03 * k, 0.25 + 0.03 * k]
    patterns = np.zeros(n, np.int64)
    for k in range(len(wq.VOTERS)):
        edges = chance[k, good.astype(int)].cumsum(1)
        patterns += (rng.random(n)[:, None] > edges).sum(1) * 3**k
    seen, counts = np.unique(patterns, return_counts=True)
    share, found = wq.estimate(seen, counts)
    assert abs(share - 0.85) < 0.02 and np.abs(found - chance).max() < 0.06
    weight = wq.posterior(patterns, share, found)
    known = wq.posterior(patterns, 0.85, chance)  # no rule can do better than this one
    assert ((weight > 0.5) == good).mean() > ((known > 0.5) == good).mean() - 0.003 > 0.95


def test_labels_that_were_never_used(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = wq.score(docs).join(labels, "doc_id").select("kept", "quality").collect()
    kept = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert np.mean(kept) > 0.97 and np.mean(bad) > 0.8


def test_odd_rows(spark, odd, odd_rows, empty):
    got = wq.score(odd, trained=20).collect()
    assert len(got) == len(odd_rows)
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (20, 21, 22))
    out = wq.good_documents(odd, trained=20)
    assert out.columns == odd.columns
    assert wq.score(empty).count() == 0 and wq.good_documents(empty).count() == 0
    plain = "The house of the rising sun is in the town and it is known to all."
    crowd = spark.createDataFrame([(i, plain if i % 3 else "@ | # | $ | " * 9) for i in range(60)], "doc_id long, text string")
    assert {(r.doc_id % 3 != 0, r.kept) for r in wq.score(crowd).collect()} == {(True, True), (False, False)}


def test_training_rows_are_parts_of_flat_arrays():
    """The driver holds the sample's features once, four bytes a number, not as objects."""
    index, value = pa.array([[3, 1], [], [2]], pa.list_(pa.int32())), pa.array([[0.5, 1.0], [], [0.25]], pa.list_(pa.float32()))
    rows = wq._rows(index, value)
    assert [(a.tolist(), b.tolist()) for a, b in rows] == [([3, 1], [0.5, 1.0]), ([], []), ([2], [0.25])]
    assert all(a.dtype == np.int32 and b.dtype == np.float32 and not a.flags.owndata and not b.flags.owndata for a, b in rows)

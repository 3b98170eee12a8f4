"""Buckets follow the data: crowded instants and crowded scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.operators import evaluate as ev
from terrascope.operators import ordered as od
from terrascope.operators import stateful as sf


def test_float_buckets_grow_with_the_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), 1 - rng.random(500) * 1e-4, rng.random(500) * 1e-7, 2.0 ** np.arange(-30, 5), np.nextafter(2.0 ** np.arange(-30, 5), 0), [0.0, -0.0, 1.0, -1.0]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", od.float_bucket(F.col("v"), 1 << 17).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))
    crowd = {r.b for r in rows if 1 - 1e-4 <= r.v < 1}
    assert len(crowd) > 10


def test_scores_within_a_ten_thousandth(spark):
    """No bucket holds more than 1,024 of the FLOAT scores, and the precision stays exact."""
    scores = np.unique(np.float32(0.7) + np.arange(1200, dtype=np.float32) * np.float32(6e-8))
    labels = [1 + i % 2 for i in range(len(scores))]
    table = spark.createDataFrame([(r, [float(s), float(1 - s)]) for r, s in zip(labels, scores)], "ref int, scores array<double>")
    got = {r.class_id: r.ap for r in ev.average_precision(table, [1, 2]).collect()}
    order = np.argsort(-scores)
    hits = np.array(labels)[order] == 1
    assert got[1] == pytest.approx(float((hits * hits.cumsum() / np.arange(1, len(hits) + 1)).sum() / hits.sum()))
    held = table.select(od.float_bucket(F.get("scores", F.lit(0)).cast("float")).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in held) <= 1024


@pytest.mark.parametrize("rows_per_bucket", [5000, 40])
def test_one_point_within_one_second(spark, monkeypatch, rows_per_bucket):
    """All rows of one point in one second: width follows the table, and the average stays right."""
    monkeypatch.setattr(od, "ROWS_PER_BUCKET", rows_per_bucket)
    rows = [(7, i, 1_700_000_000_000_000 + i * 997, 1 + i % 3, (i % 10) / 10) for i in range(1000)]
    table = spark.createDataFrame(rows, "point_id long, seq long, us long, target int, conf double").withColumn("ts", F.timestamp_micros("us"))
    width = od.bucket_width(table, F.col("us"), rows_per_bucket)
    most = table.groupBy(F.floor(F.col("us") / width)).count().agg(F.max("count")).first()[0]
    assert most <= rows_per_bucket
    got = {r.class_id: r.logit for r in sf.observation_ema(table, 4, 0.3, 2.0).collect()}
    valid = [(t, c) for _, _, _, t, c in rows if c > 0]
    expected = {k: sum(0.3 * 2.0 * c * 0.7 ** (len(valid) - 1 - i) for i, (t, c) in enumerate(valid) if t == k) for k in (1, 2, 3)}
    assert got == pytest.approx(expected)
    assert od.bucket_width(table.where("false"), F.col("us")) == 1

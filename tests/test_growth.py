"""Faults that only showed on tables far larger than the given ones, each on a small example."""

import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrascope.functions import text
from terrascope.operators import geometry as ge
from terrascope.operators import ordered
from terrascope.operators import regions
from terrascope.operators import resample as rs
from terrascope.operators.evaluate import tally_columns
from terrascope.plans import catalog
from terrascope.plans.geometry_queries import CAMERA
from terrascope.plans.inputs import Inputs
from terrascope.plans.stateful_queries import frame_counters
from terrascope.streaming import operators as streaming
from terrascope.streaming import run

SOURCE = "/root/testdata/sf0.001"


def test_appended_point_ids_pass_32_bits(spark):
    """Frames beyond 2,147 give point ids above 2^31."""
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    lines = pq.read_table(f"{SOURCE}/lineitem.parquet").slice(0, 50)
    at = lines.schema.get_field_index("l_orderkey")
    pq.write_table(lines.set_column(at, "l_orderkey", pc.add(lines["l_orderkey"], 250 * 5000)), root / "lineitem.parquet")
    pq.write_table(pq.read_table(f"{SOURCE}/events.parquet"), root / "events.parquet")
    fresh = catalog.REGISTRY["incremental_append"].run(spark, str(root)).where("is_new").collect()
    assert len(fresh) == 50 and min(r.point_id for r in fresh) >= 1_000_000_000 + 5000 * 1_000_000


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_pixels_of_masks_are_never_broadcast(spark):
    """Spread from a few bytes of a mask, pixels pass for small at any size of the table."""
    for key in ("paint_regions", "mask_nms", "mask_nms_fallback"):
        assert broadcasts(catalog.REGISTRY[key].run(spark, SOURCE)) == 0, key


def shuffled_rows(spark, df, group: str) -> int:
    """Rows written to shuffles by the jobs of ``df``."""
    spark.sparkContext.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    spark.sparkContext.setJobGroup("", "")
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_support_and_fusion_shuffle_few_copies_of_a_point(spark):
    """Sparse points, all open: some ten rows a point go through shuffles, and fusing them moves each once."""
    rng = np.random.default_rng(8)
    rows = [(f, i, *map(float, p)) for f in range(20) for i, p in enumerate(rng.uniform(0, 10, (200, 3)))]
    points = spark.createDataFrame(rows, "frame_index int, point_idx bigint, x double, y double, z double")
    supported = ge.temporal_support(points, 0.25, 3, 3, 2)
    assert shuffled_rows(spark, supported, "support") < 13 * len(rows)
    poses = spark.createDataFrame([(f, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for f in range(20)], "frame_index int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    beyond = points.withColumn("x", points.x + 10_000.0)  # outside every image
    assert shuffled_rows(spark, ge.depth_fuse_symmetric(beyond, poses, CAMERA, 3), "fuse") < 1.5 * len(rows)


@pytest.mark.parametrize("key, rows", [("dynamic_mask", 2.0), ("static_pixels", 2.6), ("depth_fuse_symmetric", 2.6), ("temporal_support", 3.0), ("dynamic_seeds", 3.0), ("temporal_filter_stats", 2.0)])
def test_support_queries_shuffle_points_once(spark, key, rows):
    """Rows that go through shuffles for a line of the table; ten to eleven where points and their cells were joined."""
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet").count()
    assert shuffled_rows(spark, catalog.REGISTRY[key].run(spark, SOURCE), f"once {key}") < rows * lines


def test_frame_counters_shuffle_few_rows(spark):
    """Points once for their support and twice for their pixels; eleven rows a line where points and their cells were joined."""
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet").count()
    spark.sparkContext.setJobGroup("counters", "counters")
    assert shuffled_rows(spark, frame_counters(Inputs(spark, SOURCE)), "counters") < 5 * lines


@pytest.mark.parametrize("per_group", [64, 1 << 17])
def test_support_in_cells_equals_brute_force(spark, monkeypatch, per_group):
    """Blocks of many points are parted into wide cells; a crowd, single points, points far out and null ones, several blocks."""
    monkeypatch.setattr(ge, "POINTS_PER_GROUP", per_group)
    rng = np.random.default_rng(11)
    rows = [(f, p) for f in range(-20, 21) for p in rng.uniform(-4, 4, (12, 3)) * (1.0, 1.0, 0.05)]
    rows += [(f, np.full(3, 1.0) + rng.normal(0, 0.1, 3)) for f in (-3, 0, 1) for _ in range(150)]
    rows += [(f, np.array([1e9, -1e9, 0.1 * f])) for f in range(-20, 21, 2)]
    frames, places = np.array([f for f, _ in rows]), np.array([p for _, p in rows])
    given = [(int(f), i, *map(float, p)) for i, (f, p) in enumerate(zip(frames, places))]
    given += [(3, 10_000, None, 1.0, 1.0), (3, 10_001, float("nan"), 1.0, 1.0)]
    table = spark.createDataFrame(given, "frame_index int, point_idx bigint, x double, y double, z double")
    got = {r.point_idx: (r.frame_index, r.x, r.support, r.motion) for r in ge.temporal_support(table, 0.25, 3, 3, 2).collect()}
    assert len(got) == len(rows)
    for i, (f, p) in enumerate(rows):
        d = places - p
        gaps = {int(g) for g in frames[(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2) <= 0.25 * 0.25] - f if 0 < abs(g) <= 3}
        low, high = max(f - 3, -20), min(f + 3, 20)
        kept = 1 + len(gaps) >= min(3, high - low + 1) and (f < low + 2 or high < f + 2 or (min(gaps) <= -2 and max(gaps) >= 2))
        motion = "static" if kept else "dynamic" if not gaps else "uncertain"
        assert got[i] == (f, p[0], 1 + len(gaps), motion), i


def test_bootstrap_draws_are_never_broadcast(spark):
    """Two thousand replicates of as many draws as there are groups."""
    rows = [(g, "oracle", 0, *[5] * 9) for g in range(30)]
    names = tally_columns([1, 2])
    shape = "group_id bigint, stage string, stage_order int, " + ", ".join(f"{n} bigint" for n in [*names, "valid_pixels"])
    tallies = spark.createDataFrame([r[: 3 + len(names) + 1] for r in rows], shape)
    plan = rs.bootstrap_replicates(tallies, [1, 2], 50, 7)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [position" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_bucket_state_takes_many_points_in_a_call():
    """One call of the state gives the partials of all points that came, and only of those."""
    class Held(list):
        exists, get, appendList = (lambda self: bool(self)), (lambda self: iter(self)), list.extend

    held, timers = Held(), []
    handle = type("Handle", (), {"getListState": lambda self, name, schema: held, "registerTimer": lambda self, ms: timers.append(ms)})()
    bucket = streaming.InBucket(1000, streaming.EmaPartial(6, 0.3, 4.0))
    bucket.init(handle)
    rows = [(p, us, us, 1 + us % 3, 0.1 + 0.001 * us) for us in range(5) for p in range(40)]
    name = ["point_id", "us", "seq", "target", "conf"]
    (first,) = bucket.handleInputRows((0, 0), iter([pd.DataFrame(rows[100:], columns=name)]), None)
    assert sorted(first["point_id"]) == list(range(40)) and len(timers) == 1
    (second,) = bucket.handleInputRows((0, 0), iter([pd.DataFrame(rows[:7], columns=name)]), None)
    assert second["point_id"].tolist() == list(range(7)) and len(timers) == 1
    for p, gains in zip(second["point_id"], second["gains"]):
        mine = sorted(r[1:] for r in [*rows[:7], *rows[100:]] if r[0] == p)
        assert gains == bucket.partial.of(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]))[1]


def test_crowded_scans_make_no_pairs_with_frames(spark, monkeypatch):
    """Frames and scans of a few minutes, many at one instant: no join of the two, and the nearest scan by brute force."""
    rng = np.random.default_rng(4)
    base = 1_704_067_200_000_000
    us = base + np.r_[rng.integers(0, 400, 500) * 1_000_000, rng.integers(2_000, 9_000, 100) * 1_000_000]
    events = pd.DataFrame({"id": np.arange(600), "us": us, "is_scan": rng.random(600) < 0.4})
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(events).selectExpr("id", "timestamp_micros(us) as ts", "is_scan").coalesce(1).write.parquet(f"{root}/rows.parquet")
    progress = []
    finish = run._finish
    monkeypatch.setattr(run, "_finish", lambda query: (finish(query), progress.extend(query.recentProgress)))
    session = run.stream_session(spark)
    closing = run.Closing(session, spark.read.parquet(f"{root}/rows.parquet").schema)
    rows = closing.after(run.file_stream(session, root, "rows", closing.schema))
    frames, scans = rows.where("not is_scan").selectExpr("id as frame_id", "ts"), rows.where("is_scan").selectExpr("id as scan_id", "ts")
    last = spark.sql("select -1L as id, timestamp '2034-01-01' as ts, false as is_scan")
    found = run.run_append(streaming.scan_match(frames, scans, 60.0, "2 seconds"), "crowd", lambda: closing.write(last)).where("frame_id >= 0").collect()
    scan = events[events.is_scan]
    expected = {}
    for f in events[~events.is_scan].itertuples():
        gap = (scan.us - f.us).abs()
        order = sorted((g, t, -i if t < f.us else i, i) for g, t, i in zip(gap, scan.us, scan.id) if g <= 60_000_000)
        expected[f.id] = (order[0][3], order[0][0] / 1e6) if order else (-1, None)
    assert len(found) == len(expected) and {r.frame_id: (r.scan_id, r.gap_s) for r in found} == expected
    assert not [o for p in progress for o in p["stateOperators"] if "Join" in o["operatorName"]]


def test_rings_of_many_cameras_take_one_call_and_one_timer():
    """A call holds all cameras of a share, and sets a timer for the earliest keyframe that waits, not one for each."""
    class Held(list):
        exists, get, appendList = (lambda self: bool(self)), (lambda self: iter(list(self))), list.extend

        def put(self, rows):
            self[:] = rows

    held, timers = {"ring": Held(), "waiting": Held()}, []
    handle = type("Handle", (), {"getListState": lambda self, name, schema: held[name], "registerTimer": lambda self, ms: timers.append(ms)})()
    rings = streaming.Rings(3)
    rings.init(handle)
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    rows = pd.DataFrame([(f * 5000 + c, c, f * 40 + c) for f in range(20) for c in range(40)], columns=["us", "camera", "frame_id"])
    parts = np.array_split(np.random.default_rng(5).permutation(len(rows)), 2)
    for part in parts:
        list(rings.handleInputRows((0,), iter([rows.iloc[part]]), now(0)))
    (first,) = rings.handleExpiredTimer((0,), now(50), None)
    assert len(first) == 400 and len(timers) == 3 and timers[-1] == 51 and len(held["ring"]) == 120
    (rest,) = rings.handleExpiredTimer((0,), now(10**6), None)
    assert len(timers) == 3 and not held["waiting"] and not list(rings.handleExpiredTimer((0,), now(10**6), None))
    for r in [*first.itertuples(index=False), *rest.itertuples(index=False)]:
        assert r.camera == r.frame_id % 40 and r.earlier == [r.frame_id - 40 * k for k in (1, 2, 3) if r.frame_id >= 40 * k]


def test_safe_labels_need_no_pattern(spark):
    """All bytes are replaced at once; nulls, empty labels and parts of a table keep their places."""
    names = ["traffic sign", "日本", None, "", "a-b_C9", "é/x" * 1000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, label string").repartition(1)
    labels = rows.sortWithinPartitions("i").select(text.safe_label(F.col("label")).alias("safe"))
    assert "regexp" not in labels._jdf.queryExecution().executedPlan().toString()
    expected = ["traffic_sign", "______", None, "query", "a-b_C9", "___x" * 1000]
    assert [r.safe for r in labels.collect()] == expected
    assert text._safe(pa.array(names).slice(1, 3)).to_pylist() == expected[1:4] and text._safe(pa.array([], pa.string())).to_pylist() == []


def test_heat_shuffles_pixels_not_a_row_for_each_query(spark):
    """Pixels become six rows each after the join."""
    pixels = spark.createDataFrame([(f, u, v, 1.0, 0.1 * u, 0.2 * v) for f in range(20) for u in range(10) for v in range(5)], "frame_index int, u int, v int, alpha double, a double, b double")
    heat = regions.minmax_heat(pixels, {1: "a", 2: "b", 3: "a", 4: "b", 5: "a", 6: "b"})
    assert shuffled_rows(spark, heat, "heat") < 1.5 * 1000
    assert heat.count() == 6000
    dark = regions.minmax_heat(pixels.withColumn("alpha", F.when(F.col("frame_index") == 3, 0.0).when(F.col("u") == 9, 0.0).otherwise(1.0)), {1: "a"})
    seen = {(r.frame_index, r.u): r.heat for r in dark.where("v = 0").collect()}
    assert len(seen) == 190 and seen[0, 0] == 0.0 and abs(seen[0, 8] - 1.0) < 1e-6 and seen[0, 9] == 0.0


def test_stride_parts_follow_the_rows(spark, monkeypatch):
    """More rows are dealt to more tasks, whatever the configured number, and places stay exact."""
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 50)
    rows = [(f, (b << 20) + p) for f in (0, 1, None) for b in range(40) for p in range(1 + (b * 7 + (f or 3)) % 5)]
    sampled = ge.stride_sample(spark.createDataFrame(rows, "frame_index int, point_idx bigint").repartition(5), 4)
    assert f", {-(-len(rows) // 50)})" in sampled._jdf.queryExecution().executedPlan().toString() and len(rows) > 300
    expected = [r for k in (0, 1, None) for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[::4]]
    assert sorted(map(str, map(tuple, sampled.collect()))) == sorted(map(str, expected))

"""Every stream gives one answer for any file layout of its table."""

import os
import tempfile
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_queries import compare

from terrascope.plans import catalog, stateful_queries
from terrascope.streaming.operators import EmaPartial, SwitchPartial
from terrascope.streaming import operators as so
from terrascope.streaming import run
from terrascope.streaming.run import file_stream, run_append, stream_session

SOURCE = "/root/testdata/sf0.001/events.parquet"
STREAMS = ["frame_ingest_stream", "observation_ema_stream", "observation_switch_stream", "evidence_stream", "stream_scan_match", "stream_frame_metrics", "keyframe_ring_stream", "incremental_append_stream"]


@pytest.fixture(scope="module")
def layouts():
    """A folder of 200 files in mixed time order, and one of three files."""
    events = pq.read_table(SOURCE)
    order = np.random.default_rng(3).permutation(len(events))
    found = []
    for files in (200, 3):
        root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        (root / "events.parquet").mkdir()
        for i, rows in enumerate(np.array_split(order, files)):
            pq.write_table(events.take(pa.array(rows)), root / "events.parquet" / f"part-{i:04d}.parquet")
        found.append(str(root))
    return found


@pytest.mark.parametrize("key", STREAMS)
def test_layouts_agree_with_check(spark, layouts, key):
    query = catalog.REGISTRY[key]
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SOURCE}'")
    expected = db.execute(query.check).to_arrow_table()
    for folder in layouts:
        assert compare(query.run(spark, folder).toArrow(), expected) == "ok", folder


def test_late_rows_are_an_error(spark, layouts):
    session = stream_session(spark)
    events = file_stream(session, layouts[0], "events", spark.read.parquet(SOURCE).schema)
    counted = events.withColumn("event_time", events.ts.cast("timestamp")).withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    with pytest.raises(RuntimeError, match="watermark"):
        run_append(counted.select("event_id"), "late")


def one_by_one(observations, alpha, scale, bound):
    label, strength, pending, support = 0, 0.0, 0, 0.0
    for target, conf in observations:
        if abs(strength) <= 1e-6 or label == target:
            label, strength, pending, support = target, (1 - alpha) * strength + alpha * conf * scale, 0, 0.0
            continue
        support = support + conf if pending == target else conf
        pending = target
        if support >= bound:
            label, strength, pending, support = target, conf * scale, 0, 0.0
    return len(observations), label, strength, pending, support


@pytest.mark.parametrize("size", [1, 2, 7, 40, 1000])
@pytest.mark.parametrize("least", [0.0, 0.3])
def test_partials_compose(size, least):
    """Partials of stretches of any length, applied in order, equal the rule replayed one by one."""
    rng = np.random.default_rng(size)
    target = rng.integers(1, 5, 300).repeat(rng.integers(1, 9, 300))
    conf = least + (1 - least) * rng.random(len(target)) ** 3 + 1e-3
    rule = SwitchPartial(6, 0.3, 4.0, 1.505)
    state = (0, 0, 0.0, 0, 0.0)
    for at in range(0, len(target), size):
        state = rule.apply(state, rule.of(target[at : at + size], conf[at : at + size]))
        end = min(at + size, len(target))
        np.testing.assert_allclose(state, one_by_one(list(zip(target[:end].tolist(), conf[:end].tolist())), 0.3, 4.0, 1.505), rtol=1e-9)
    ema = EmaPartial(6, 0.3, 4.0)
    whole, parts = np.array(ema.of(target, conf)[1]), np.zeros(6)
    for at in range(0, len(target), size):
        n, gains = ema.of(target[at : at + size], conf[at : at + size])
        parts = 0.7**n * parts + gains
    np.testing.assert_allclose(parts, whole, rtol=1e-9, atol=1e-300)


def test_switch_rule():
    """One class holds until the support of another reaches the bound."""
    rule = SwitchPartial(3, 0.5, 2.0, 1.0)
    state = rule.apply((0, 0, 0.0, 0, 0.0), rule.of(np.array([1, 2, 2, 1, 2]), np.array([1.0, 0.4, 0.4, 0.5, 0.9])))
    assert state == (5, 1, 1.0, 2, 0.9)
    assert rule.apply(state, rule.of(np.array([2]), np.array([0.2]))) == (6, 2, 0.4, 0, 0.0)


@pytest.fixture(scope="module")
def nearly_in_order():
    """Two hundred files in time order, rows up to an hour late, a third of them of one point."""
    rng = np.random.default_rng(9)
    events = pq.read_table(SOURCE)
    user = np.where(rng.random(len(events)) < 1 / 3, 7, events["user_id"].to_numpy())
    events = events.set_column(events.schema.get_field_index("user_id"), "user_id", pa.array(user, pa.int64()))
    us = events["ts"].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
    order = np.argsort(us + rng.integers(0, 1_750_000_000, len(us)))
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (root / "events.parquet").mkdir()
    for i, rows in enumerate(np.array_split(order, 200)):
        path = root / "events.parquet" / f"part-{i:04d}.parquet"
        pq.write_table(events.take(pa.array(rows)), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(root), events


def test_state_is_bounded_by_open_buckets(spark, nearly_in_order, monkeypatch):
    """With a delay of an hour the answer is that of the whole table, and closed buckets leave the state."""
    folder, events = nearly_in_order
    db = duckdb.connect()
    db.register("events", events)
    held = []
    finish = run._finish
    monkeypatch.setattr(run, "_finish", lambda query: (finish(query), held.append([o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]])))
    monkeypatch.setattr(stateful_queries, "delay", lambda t: "1 hour")
    slow = file_stream
    monkeypatch.setattr(stateful_queries, "file_stream", lambda *args: slow(*args, files_per_batch=10))
    for key in ("observation_ema_stream", "observation_switch_stream"):
        query = catalog.REGISTRY[key]
        assert compare(query.run(spark, folder).toArrow(), db.execute(query.check).to_arrow_table()) == "ok", key
    for rows in held:
        assert len(rows) >= 20 and max(rows) < len(events) / 4


def test_frames_without_scan_come_out_with_the_watermark(spark, nearly_in_order, monkeypatch):
    """The nearest scan in one query: matched and unmatched frames come out while the stream runs, and leave the state."""
    folder, events = nearly_in_order
    db = duckdb.connect()
    db.register("events", events)
    progress = []
    finish = run._finish
    monkeypatch.setattr(run, "_finish", lambda query: (finish(query), progress.append([p for p in query.recentProgress])))
    monkeypatch.setattr(stateful_queries, "delay", lambda t: "1 hour")
    slow = file_stream
    monkeypatch.setattr(stateful_queries, "file_stream", lambda *args: slow(*args, files_per_batch=20))
    query = catalog.REGISTRY["stream_scan_match"]
    assert compare(query.run(spark, folder).toArrow(), db.execute(query.check).to_arrow_table()) == "ok"
    before, after = progress
    out = sum(o["numRowsRemoved"] for p in before for o in p["stateOperators"] if o["operatorName"] == "stateStoreSave")
    assert out > 0.8 * db.execute("select count(*) from events where event_type in ('view', 'click', 'purchase')").fetchone()[0]
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in [*before, *after]]
    assert max(rows) < len(events) and rows[-1] < 30


def test_ring_never_exceeds_its_size():
    """Rows in any order within the delay; the ring holds the last keyframes in time order."""
    class Held:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

        def clear(self):
            self.rows = []

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    held = {"ring": Held(), "waiting": Held()}
    timers = []
    handle = type("Handle", (), {"getListState": lambda self, name, schema: held[name], "registerTimer": lambda self, ms: timers.append(ms)})()
    ring = so.Ring(3)
    ring.init(handle)
    rng = np.random.default_rng(2)
    order = np.argsort(np.arange(200) + rng.integers(0, 9, 200))
    out, latest = [], 0
    for part in np.array_split(order, 23):
        list(ring.handleInputRows((7,), iter([pd.DataFrame({"us": part * 5_000, "frame_id": part})]), Now(0)))
        latest = max(latest, int(part.max()) * 5)
        out += [r for frame in ring.handleExpiredTimer((7,), Now(latest - 50), None) for r in frame.itertuples(index=False)]
        assert len(held["ring"].rows) <= 3 and len(held["waiting"].rows) <= 30
    out += [r for frame in ring.handleExpiredTimer((7,), Now(10**9), None) for r in frame.itertuples(index=False)]
    assert [r.frame_id for r in out] == list(range(200)) and all(r.earlier == [r.frame_id - k for k in (1, 2, 3) if r.frame_id >= k] for r in out)
    assert set(timers) >= {5 * f + 1 for f in range(200)} and not held["waiting"].rows

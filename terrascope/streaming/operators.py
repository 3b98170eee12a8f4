"""Streaming twins of the incremental operators."""

from __future__ import annotations

from bisect import bisect_left
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrascope.functions.numeric import clip
from terrascope.operators.frames import keyframe


def frame_ingest(frames: DataFrame, period: int, offset: int) -> DataFrame:
    """Frames as they arrive, marked as keyframe (updates state) or evaluation only."""
    return frames.withColumn("is_keyframe", keyframe(F.col("frame_id"), period, offset))


def valid_observations(observations: DataFrame, class_count: int) -> DataFrame:
    valid = F.col("target").between(1, class_count - 1) & (F.col("conf") > 0)
    return observations.where(valid).withColumn("conf", clip(F.col("conf"), 0.0, 1.0))


class InBucket(StatefulProcessor):
    """The observations of one share of the points in one time bucket, until the watermark passes the bucket.

    Whenever rows come, the bucket's partials of their points are emitted anew; the one with the most
    rows counts. A timer at the end of the bucket drops its state, so the state holds open buckets alone.
    """

    names = ["point_id", "us", "seq", "target", "conf"]

    def __init__(self, width_us: int, partial):
        self.width_us, self.partial = width_us, partial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "point_id bigint, us bigint, seq bigint, target int, conf double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket = int(key[1])
        fresh = pd.concat([r[self.names] for r in rows], ignore_index=True)
        batch = fresh
        if self.rows.exists():
            held = pd.DataFrame(list(self.rows.get()), columns=self.names)
            batch = pd.concat([held[held["point_id"].isin(fresh["point_id"].unique())], fresh], ignore_index=True)
        else:
            self.handle.registerTimer((bucket + 1) * self.width_us // 1000)
        self.rows.appendList(list(zip(*(fresh[n].tolist() for n in self.names))))
        batch = batch.sort_values(["point_id", "us", "seq"], kind="stable")
        points, target, conf = batch["point_id"].to_numpy("int64"), batch["target"].to_numpy("int64"), batch["conf"].to_numpy("float64")
        cuts = np.flatnonzero(np.diff(points)) + 1
        parts = zip(points[np.r_[0, cuts]].tolist(), np.split(target, cuts), np.split(conf, cuts))
        yield self.partial.frame([(point, bucket, *self.partial.of(kinds, weights)) for point, kinds, weights in parts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def _decayed(alpha: float, n: int) -> np.ndarray:
    """Weights of ``n`` observations in order, the last one undamped."""
    return (1.0 - alpha) ** np.arange(n - 1, -1, -1)


class EmaPartial:
    """What some observations in order add to a class vector; vectors before them are damped by their number."""

    shape = "point_id bigint, bucket bigint, seen bigint, gains array<double>"

    def __init__(self, class_count: int, alpha: float, scale: float):
        self.class_count, self.alpha, self.scale = class_count, alpha, scale

    def of(self, target: np.ndarray, conf: np.ndarray) -> tuple[int, list[float]]:
        weights = self.alpha * self.scale * conf * _decayed(self.alpha, len(conf))
        return len(conf), np.bincount(target, weights, self.class_count).tolist()

    def frame(self, partials: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(partials, columns=["point_id", "bucket", "seen", "gains"])


class SwitchPartial:
    """What some observations in order do to a class with hysteresis, whatever its state before.

    A run is a stretch of one target. Only the first run can meet support that is pending for
    its target; it is kept as the confidences up to the one that switches without any (``head``)
    and the gain of those after it. What the later runs do depends on the label alone, so
    they become one action per label: the label, pending label and support after them, and the
    strength as ``keep * strength + add``. Partials apply one after the other; the first
    observation of a point must lift its strength over 1e-6.
    """

    shape = (
        "point_id bigint, bucket bigint, seen bigint, target int, head array<double>, rest bigint, rest_gain double, more boolean, "
        "actions array<struct<label:int,pending:int,support:double,keep:double,add:double>>"
    )

    def __init__(self, class_count: int, alpha: float, scale: float, switch_support: float):
        self.class_count, self.alpha, self.scale, self.switch_support = class_count, alpha, scale, switch_support

    def _gain(self, conf: np.ndarray) -> float:
        return float((self.alpha * self.scale * conf * _decayed(self.alpha, len(conf))).sum())

    def _damp(self, n: int) -> float:
        return (1.0 - self.alpha) ** n

    def _switched(self, conf: np.ndarray) -> float:
        """Strength of a label set by the first of these."""
        return self._damp(len(conf) - 1) * float(conf[0]) * self.scale + self._gain(conf[1:])

    def _action(self, label: int, runs: list[tuple[int, np.ndarray]]) -> tuple:
        pending, support, keep, add = 0, 0.0, 1.0, 0.0
        for kind, conf in runs:
            if label == kind:
                damp = self._damp(len(conf))
                pending, support, keep, add = 0, 0.0, keep * damp, add * damp + self._gain(conf)
                continue
            sums = np.cumsum(conf)
            at = int(np.searchsorted(sums, self.switch_support))
            if at == len(conf):
                pending, support = kind, float(sums[-1])
            else:
                label, pending, support, keep, add = kind, 0, 0.0, 0.0, self._switched(conf[at:])
        return label, pending, support, keep, add

    def of(self, target: np.ndarray, conf: np.ndarray) -> tuple:
        """``seen, target, head, rest, rest_gain, more, actions``."""
        cuts = np.flatnonzero(np.diff(target)) + 1
        runs = [(int(kind[0]), part) for kind, part in zip(np.split(target, cuts), np.split(conf, cuts))]
        kind, first = runs[0]
        ends = int(np.searchsorted(np.cumsum(first), self.switch_support)) + 1
        rest = first[ends:]
        actions = [self._action(label, runs[1:]) for label in range(1, self.class_count)] if len(runs) > 1 else []
        return len(target), kind, first[:ends].tolist(), len(rest), self._gain(rest), len(runs) > 1, actions

    def frame(self, partials: list[tuple]) -> pd.DataFrame:
        names = ["point_id", "bucket", "seen", "target", "head", "rest", "rest_gain", "more", "actions"]
        return pd.DataFrame(partials, columns=names)

    def apply(self, state: tuple, partial: tuple) -> tuple:
        """State ``seen, label, strength, pending label, pending support`` after a partial."""
        seen, label, strength, pending, support = state
        more_seen, kind, head, rest, rest_gain, more, actions = partial
        head = np.asarray(head, dtype=float)
        if abs(strength) <= 1e-6 or label == kind:
            label, strength, pending, support = kind, self._damp(len(head)) * strength + self._gain(head), 0, 0.0
            strength = self._damp(rest) * strength + rest_gain
        else:
            sums = np.cumsum(np.r_[support if pending == kind else 0.0, head])[1:]
            at = int(np.searchsorted(sums, self.switch_support))
            if at == len(head):
                pending, support = kind, float(sums[-1])
            else:
                label, pending, support = kind, 0, 0.0
                strength = self._damp(rest) * self._switched(head[at:]) + rest_gain
        if more:
            label, pending, support, keep, add = actions[label - 1]
            strength = keep * strength + add
        return seen + more_seen, label, strength, pending, support


#: Shares that the points of a time bucket are dealt to. A call of the state costs milliseconds, so it takes many points.
SHARES = 512


def _partials(observations: DataFrame, partial, class_count: int, delay: str, width_s: int) -> DataFrame:
    rows = valid_observations(observations, class_count).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    us = F.unix_micros("event_time")
    bucket = F.floor(us / F.lit(float(width_s * 1_000_000))).cast("bigint")
    share = F.pmod(F.xxhash64("point_id"), F.lit(SHARES)).alias("share")
    keyed = rows.select(share, bucket.alias("bucket"), "point_id", "event_time", us.alias("us"), "seq", "target", "conf").groupBy("share", "bucket")
    return keyed.transformWithStateInPandas(InBucket(width_s * 1_000_000, partial), partial.shape, "Append", "EventTime")


def ema_partials(observations: DataFrame, class_count: int, alpha: float, scale: float, delay: str, width_s: int = 86_400) -> DataFrame:
    """Partial per point and time bucket after each batch. ``delay``: how late an observation may come."""
    return _partials(observations, EmaPartial(class_count, alpha, scale), class_count, delay, width_s)


def switch_partials(observations: DataFrame, class_count: int, alpha: float, scale: float, switch_support: float, delay: str, width_s: int = 86_400) -> DataFrame:
    """Partial per point and time bucket after each batch. ``delay``: how late an observation may come."""
    return _partials(observations, SwitchPartial(class_count, alpha, scale, switch_support), class_count, delay, width_s)


def _latest(emitted: DataFrame) -> DataFrame:
    """Last partial of every point and bucket: the one that has seen most."""
    rest = [c for c in emitted.columns if c not in ("point_id", "bucket")]
    return emitted.groupBy("point_id", "bucket").agg(F.max_by(F.struct(*rest), "seen").alias("s")).select("point_id", "bucket", "s.*")


def composed_ema(emitted: DataFrame, alpha: float) -> DataFrame:
    """``point_id, class_id, logit`` from the partials of all buckets; a window orders buckets, not observations."""
    later = F.coalesce(F.sum("seen").over(Window.partitionBy("point_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    damped = _latest(emitted).withColumn("_damp", F.pow(F.lit(1.0 - alpha), later.cast("double")))
    gains = damped.select("point_id", "_damp", F.posexplode("gains").alias("class_id", "gain")).where("gain > 0")
    return gains.groupBy("point_id", "class_id").agg(F.sum(F.col("gain") * F.col("_damp")).alias("logit"))


def composed_switch(emitted: DataFrame, class_count: int, alpha: float, scale: float, switch_support: float) -> DataFrame:
    """State of every point: its partials apply in the order of their buckets, read in a stream."""
    rule = SwitchPartial(class_count, alpha, scale, switch_support)
    names = ["point_id", "seen", "label", "strength", "pending_label", "pending_support"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        point, state = None, None
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                if row.point_id != point:
                    if state is not None:
                        done.append((point, *state))
                    point, state = row.point_id, (0, 0, 0.0, 0, 0.0)
                actions = [tuple(a[n] for n in ("label", "pending", "support", "keep", "add")) if isinstance(a, dict) else tuple(a) for a in row.actions]
                state = rule.apply(state, (row.seen, row.target, row.head, row.rest, row.rest_gain, row.more, actions))
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(point, *state)], columns=names)

    ordered = _latest(emitted).repartition("point_id").sortWithinPartitions("point_id", "bucket")
    return ordered.mapInPandas(run, "point_id bigint, seen bigint, label int, strength double, pending_label int, pending_support double")


def evidence(observations: DataFrame, class_count: int) -> DataFrame:
    """Running evidence, largest and summed confidence per point and class (update mode)."""
    return (
        valid_observations(observations, class_count)
        .groupBy("point_id", F.col("target").alias("class_id"))
        .agg(F.sum("conf").alias("evidence"), F.max("conf").alias("support_max"))
    )


def _matched(own: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    """Frames of some time buckets with their nearest scan, however far; null without any.

    All scans of the batch serve all its frames: those of other buckets are only farther.
    """
    column = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
    events, ends = own.flatten(), [rows.drop_null() for rows in (before, after)]
    us, ids, is_scan = column(events, "us"), column(events, "id"), column(events, "is_scan")
    scan_us = np.concatenate([us[is_scan], *[column(rows, "us") for rows in ends]])
    scan_id = np.concatenate([ids[is_scan], *[column(rows, "id") for rows in ends]])
    order = np.lexsort((scan_id, scan_us))
    scan_us, scan_id = scan_us[order], scan_id[order]
    frame_us = us[~is_scan]
    # Of equal earlier instants the last scan counts, of equal later ones the first.
    at = np.searchsorted(scan_us, frame_us, "left")
    far = np.int64(2**62)
    padded_us, padded_id = np.r_[np.int64(0), scan_us, np.int64(0)], np.r_[np.int64(-1), scan_id, np.int64(-1)]
    back = np.where(at > 0, frame_us - padded_us[at], far)
    ahead = np.where(at < len(scan_us), padded_us[at + 1] - frame_us, far)
    gap = np.minimum(back, ahead)
    found = np.where(back <= ahead, padded_id[at], padded_id[at + 1])
    names, none = ["frame_id", "frame_us", "scan_id", "gap"], gap == far
    frames = pa.StructArray.from_arrays([pa.array(ids[~is_scan]), pa.array(frame_us), pa.array(found, mask=none), pa.array(gap, mask=none)], names)
    lengths = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    upto = np.r_[0, np.cumsum(lengths)]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(~is_scan)][upto], pa.int32()), frames)


def scan_match(frames: DataFrame, scans: DataFrame, tolerance_s: float, delay: str) -> DataFrame:
    """Nearest scan of each frame within the tolerance, the earlier one on a tie; -1 without a gap if there is none.

    One query in append mode without pairs. Frames and scans gather in tolerance-wide time
    buckets; of the buckets beside its own, a frame can need the last scan before or the first
    after, so a scan also goes to both neighbours, where one row of them is kept. A bucket is
    matched once the watermark has passed all instants at which a scan for it could still come;
    then it leaves the state. A frame that was given twice comes out once.
    """
    width = int(tolerance_s * 1_000_000)
    step = F.expr(f"interval {width} microseconds")
    ts = F.col("ts").cast("timestamp")
    event = lambda name, is_scan: F.struct(F.unix_micros(ts).alias("us"), F.col(name).cast("bigint").alias("id"), F.lit(is_scan).alias("is_scan"))
    beside = F.explode(F.array(*[F.struct((ts + sign * step if sign else ts).alias("at"), F.lit(sign).alias("side")) for sign in (-1, 0, 1)]))
    copies = scans.select(beside.alias("b"), event("scan_id", True).alias("e")).select("b.at", "b.side", "e")
    both = frames.select(ts.alias("at"), F.lit(0).alias("side"), event("frame_id", False).alias("e")).unionByName(copies)
    # A copy lies up to the tolerance ahead of its scan, another one as far behind.
    timed = both.withWatermark("at", f"{delay} {2 * width} microseconds")
    of = lambda side: F.when(F.col("side") == side, F.col("e"))
    buckets = timed.groupBy(F.window("at", f"{width} microseconds").alias("bucket")).agg(
        F.collect_list(of(0)).alias("own"), F.max(of(1)).alias("before"), F.min(of(-1)).alias("after")
    )
    matched = F.arrow_udf(_matched, "array<struct<frame_id:bigint,frame_us:bigint,scan_id:bigint,gap:bigint>>")
    found = buckets.select("bucket", F.explode(matched("own", "before", "after")).alias("f")).select("bucket", "f.*")
    near = F.when(F.col("gap") <= width, F.struct("scan_id", "gap"))
    best = found.groupBy("bucket", "frame_id", "frame_us").agg(F.min(near).alias("s"))
    return best.select(
        "frame_id", F.timestamp_micros("frame_us").alias("frame_ts"), F.coalesce("s.scan_id", F.lit(-1).cast("bigint")).alias("scan_id"), (F.col("s.gap") / 1e6).alias("gap_s")
    )


def frame_metrics(events: DataFrame, delay: str, window: str = "6 hours") -> DataFrame:
    """Counters per tumbling window and kind, open windows too: in update mode the last emission counts."""
    return (
        events.withColumn("event_time", F.col("ts").cast("timestamp"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window), "event_type")
        .agg(F.count(F.lit(1)).alias("frames"), F.sum("value").alias("total"), F.max("value").alias("largest"))
        .select(F.col("window.start").alias("window_start"), "event_type", "frames", "total", "largest")
    )


def counted_frames(frames: DataFrame, counters: DataFrame, delay: str, window: str = "6 hours") -> DataFrame:
    """Sums of per-frame counters over the frames that arrive in each tumbling window, by kind; a window comes out once.

    ``frames``: ts, event_type, frame_index. ``counters``: frame_index and the counters of a
    frame, a static table with a row per frame. A frame without a row counts with zeros.
    """
    names = [c for c in counters.columns if c != "frame_index"]
    timed = frames.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in names]
    return (
        timed.join(counters, "frame_index", "left")
        .groupBy(F.window("event_time", window), "event_type")
        .agg(F.count(F.lit(1)).alias("frames"), *sums)
        .select(F.col("window.start").alias("window_start"), "event_type", "frames", *names)
    )


class Ring(StatefulProcessor):
    """The last keyframes of one camera, never more than ``size``, in time order.

    A keyframe waits until the watermark has passed it; then it is emitted with the keyframes in
    the ring, newest first, and takes the place of the oldest.
    """

    shape = "camera bigint, frame_id bigint, us bigint, earlier array<bigint>"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "frame_id bigint")
        self.waiting = handle.getListState("waiting", "us bigint, frame_id bigint")

    def _passed(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting = sorted((int(us), int(frame)) for us, frame in self.waiting.get()) if self.waiting.exists() else []
        passed = [w for w in waiting if w[0] < watermark_ms * 1000]
        if not passed:
            return
        self.waiting.put(waiting[len(passed) :]) if len(passed) < len(waiting) else self.waiting.clear()
        ring = [int(r[0]) for r in self.ring.get()] if self.ring.exists() else []
        out = []
        for us, frame in passed:
            out.append((int(key[0]), frame, us, ring[::-1]))
            ring = [*ring, frame][-self.size :]
        self.ring.put([(frame,) for frame in ring])
        yield pd.DataFrame(out, columns=["camera", "frame_id", "us", "earlier"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[["us", "frame_id"]] for r in rows], ignore_index=True)
        self.waiting.appendList(list(zip(fresh["us"].tolist(), fresh["frame_id"].tolist())))
        for ms in set((fresh["us"] // 1000 + 1).tolist()):
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Rings(Ring):
    """The rings of one share of the cameras. A call of the state costs milliseconds, so it takes many cameras.

    One timer is set for the earliest keyframe that waits; when it fires, the next one is set.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "camera bigint, frame_id bigint")
        self.waiting = handle.getListState("waiting", "us bigint, camera bigint, frame_id bigint")

    def _passed(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(tuple(map(int, row)) for row in self.waiting.get()) if self.waiting.exists() else []
        upto = bisect_left(waiting, (watermark_ms * 1000,))
        if upto < len(waiting):
            self.handle.registerTimer(waiting[upto][0] // 1000 + 1)
        if not upto:
            return
        self.waiting.put(waiting[upto:]) if upto < len(waiting) else self.waiting.clear()
        rings: dict[int, list[int]] = {}
        for camera, frame in self.ring.get() if self.ring.exists() else ():
            rings.setdefault(int(camera), []).append(int(frame))
        out = []
        for us, camera, frame in waiting[:upto]:
            ring = rings.get(camera, [])
            out.append((camera, frame, us, ring[::-1]))
            rings[camera] = [*ring, frame][-self.size :]
        self.ring.put([(camera, frame) for camera, ring in rings.items() for frame in ring])
        yield pd.DataFrame(out, columns=["camera", "frame_id", "us", "earlier"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[["us", "camera", "frame_id"]] for r in rows], ignore_index=True)
        self.waiting.appendList(list(zip(*(fresh[n].tolist() for n in fresh.columns))))
        self.handle.registerTimer(int(fresh["us"].min()) // 1000 + 1)
        return iter(())


def keyframe_ring(keyframes: DataFrame, size: int, delay: str) -> DataFrame:
    """Every keyframe with up to ``size`` keyframes of its camera before it, newest first.

    ``keyframes``: camera, frame_id, ts.
    """
    timed = keyframes.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    share = F.pmod(F.xxhash64("camera"), F.lit(SHARES)).alias("share")
    keyed = timed.select(share, "camera", "event_time", F.unix_micros("event_time").alias("us"), "frame_id").groupBy("share")
    return keyed.transformWithStateInPandas(Rings(size), Rings.shape, "Append", "EventTime")


class SavedMap(StatefulProcessor):
    """Evidence per class of one map point: what the saved map holds, and all observations since.

    A point that the saved map lacks is new and starts with no evidence.
    """

    shape = "point_id bigint, is_new boolean, seen bigint, evidence array<double>"

    def __init__(self, class_count: int):
        self.class_count = class_count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.point = handle.getValueState("point", "is_new boolean, seen bigint, evidence array<double>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        known = [0.0] * self.class_count
        if self.point.exists():
            known = list(self.point.get()[2])
        for kind, amount in zip(initialState["class_id"].tolist(), initialState["evidence"].tolist()):
            known[int(kind)] += float(amount)
        self.point.update((False, 0, known))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        is_new, seen, evidence = self.point.get() if self.point.exists() else (True, 0, [0.0] * self.class_count)
        evidence = np.asarray(evidence, dtype=float)
        for part in rows:
            seen += len(part)
            evidence = evidence + np.bincount(part["target"].to_numpy("int64"), part["conf"].to_numpy("float64"), self.class_count)
        self.point.update((bool(is_new), int(seen), evidence.tolist()))
        yield pd.DataFrame({"point_id": [int(key[0])], "is_new": [bool(is_new)], "seen": [int(seen)], "evidence": [evidence.tolist()]})

    def close(self) -> None:
        pass


def appended_map(saved: DataFrame, observations: DataFrame, class_count: int) -> DataFrame:
    """Points touched by a batch, after it, going on from a saved map ``point_id, class_id, evidence``."""
    keyed = valid_observations(observations, class_count).select("point_id", "target", "conf").groupBy("point_id")
    return keyed.transformWithStateInPandas(SavedMap(class_count), SavedMap.shape, "Append", "None", initialState=saved.groupBy("point_id"))

"""Frame selection, splits, temporal alignment and pose sampling."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.rigid import POSE, with_slerp
from terrascope.functions.single import attach
from terrascope.operators.ordered import bracket_in_time, bucket_width, with_positions


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def lerp(first: Sequence[str], second: Sequence[str], amount: str) -> list[str]:
    return [f"({a} * (1D - {amount}) + {b} * {amount})" for a, b in zip(first, second)]


# --- temporal alignment -----------------------------------------------------------

def nearest_scan(frames: DataFrame, scans: DataFrame, tolerance_s: float) -> DataFrame:
    """Nearest scan in time per frame; the earlier one on a tie, -1 out of tolerance.

    frames(frame_id, ts), scans(scan_id, ts). Equal instants collapse before any
    ordering: the last scan of an earlier instant and the first of a later one are
    the candidates.
    """
    asked = frames.select(micros(F.col("ts")).alias("us"), "frame_id")
    events = (
        scans.select(micros(F.col("ts")).alias("us"), "scan_id")
        .groupBy("us")
        .agg(F.max("scan_id").alias("low"), F.min("scan_id").alias("high"))
    )
    width = bucket_width(asked.select("us").union(scans.select(micros(F.col("ts")))), F.col("us"))
    bracket = bracket_in_time(asked.select("us").distinct(), events, width)
    back = F.col("us") - F.col("before.us")
    ahead = F.col("after.us") - F.col("us")
    earlier = F.col("after").isNull() | (back <= ahead)
    chosen = bracket.select(
        "us",
        F.when(earlier, F.col("before.payload")).otherwise(F.col("after.payload")).alias("scan"),
        F.when(earlier, back).otherwise(ahead).alias("gap_us"),
    )
    matched = F.col("gap_us") <= int(round(tolerance_s * 1_000_000))
    return asked.join(chosen, "us", "left").select(
        "frame_id",
        F.when(matched, F.col("scan")).otherwise(F.lit(-1)).cast("bigint").alias("scan_id"),
        (F.col("gap_us") / 1e6).alias("gap_s"),
    )


def nearest_scan_stats(matches: DataFrame) -> DataFrame:
    gap = F.when(F.col("scan_id") >= 0, F.col("gap_s"))
    return matches.agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(gap).alias("matched_frames"),
        F.avg(gap).alias("mean_gap_s"),
        F.max(gap).alias("max_gap_s"),
    )


def pose_interpolation(asked: DataFrame, poses: DataFrame) -> DataFrame:
    """Pose at every asked instant: bracketing poses, lerp and slerp, clamped at the ends.

    asked(ask_id, ts), poses(ts, qw..tz) with distinct instants.
    """
    pose = F.struct(*POSE)
    events = poses.select(micros(F.col("ts")).alias("us"), pose.alias("low"), pose.alias("high"))
    wanted = asked.select(micros(F.col("ts")).alias("us"), "ask_id")
    width = bucket_width(wanted.select("us").union(events.select("us")), F.col("us"))
    bracket = bracket_in_time(wanted.select("us").distinct(), events, width)
    amount = "(us - before.us) / (after.us - before.us)"
    first = [f"before.payload.{n}" for n in POSE]
    second = [f"after.payload.{n}" for n in POSE]
    turned = with_slerp(bracket, first[:4], second[:4], amount)
    mixed = [*[f"_s{i}" for i in range(4)], *lerp(first[4:], second[4:], f"({amount})")]
    resolved = turned.selectExpr(
        "us",
        *[
            f"case when before is null then {b} when after is null then {a} else {m} end as {name}"
            for name, a, b, m in zip(POSE, first, second, mixed)
        ],
    )
    return wanted.join(resolved, "us").drop("us")


# --- keyframes and splits ------------------------------------------------------------

def keyframe(frame: Column, period: int, offset: int) -> Column:
    return F.pmod(frame, F.lit(period)) == offset


def mapper_keyframe(frame: Column, period: int) -> Column:
    """Keyframe rule of the mapper, where the running count starts at the frame id."""
    return F.pmod(frame + 1, F.lit(period)) == 0


def disjoint_scan_split(alignment: DataFrame, period: int, offset: int) -> DataFrame:
    """train / unmatched / shared_scan_excluded / heldout, in that precedence.

    Unmatched frames share one scan id, so they are kept out of the join.
    """
    flagged = alignment.withColumn("_train", keyframe(F.col("frame_index"), period, offset))
    train_scans = (
        flagged.where(F.col("_train") & (F.col("label_scan_index") >= 0))
        .select("label_scan_index")
        .distinct()
        .withColumn("_shared", F.lit(True))
    )
    settled = flagged.where(F.col("_train") | (F.col("label_scan_index") < 0)).withColumn(
        "split", F.when(F.col("_train"), "train").otherwise("unmatched")
    )
    open_frames = (
        flagged.where(~F.col("_train") & (F.col("label_scan_index") >= 0))
        .join(train_scans, "label_scan_index", "left")
        .withColumn("split", F.when(F.col("_shared"), "shared_scan_excluded").otherwise("heldout"))
    )
    columns = ["frame_index", "label_scan_index", "split"]
    return settled.select(*columns).unionByName(open_frames.select(*columns))


def split_summary(splits: DataFrame) -> DataFrame:
    """Size, scan count and frame range of each split."""
    matched = F.when(F.col("label_scan_index") >= 0, F.col("label_scan_index"))
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_distinct(matched).alias("scans"),
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
    )


def split_members(splits: DataFrame) -> DataFrame:
    """The listed frames and training scans, one row each instead of one long array."""
    frames = splits.where(F.col("split") != "heldout").select(
        F.concat("split", F.lit("_frames")).alias("list"), F.col("frame_index").alias("member")
    )
    scans = (
        splits.where((F.col("split") == "train") & (F.col("label_scan_index") >= 0))
        .select(F.lit("training_label_scans").alias("list"), F.col("label_scan_index").alias("member"))
        .distinct()
    )
    return frames.unionByName(scans)


def missing_alignment(alignment: DataFrame, first_frame: int, last_frame: int) -> DataFrame:
    wanted = alignment.sparkSession.range(first_frame, last_frame + 1).select(
        F.col("id").cast("int").alias("frame_index")
    )
    return wanted.join(alignment, "frame_index", "left_anti")


def frame_window(rows: DataFrame, start_frame: int, max_frames: int, radius: int) -> DataFrame:
    """Processed frames plus ``radius`` context frames after them, marked by ``emit``.

    Context frames are read by window operators but not emitted.
    """
    last = start_frame + max_frames - 1
    return rows.where(F.col("frame_index").between(start_frame, last + radius)).withColumn(
        "emit", F.col("frame_index") <= last
    )


def seed_points(points: DataFrame, period: int, strict: bool) -> DataFrame:
    """Under strict hold-out only keyframe points may seed the map."""
    return points.where(mapper_keyframe(F.col("frame_index"), period)) if strict else points


def check_holdout_flags(
    strict: bool, temporal_filter: bool = False, static_depth_fusion: bool = False, depth_accum_frames: int = 1
) -> None:
    """Reject settings by which held-out points leak through neighbouring frames."""
    if strict and (temporal_filter or static_depth_fusion or depth_accum_frames != 1):
        raise ValueError("strict hold-out excludes temporal filter, depth fusion and depth accumulation")


def seed_leaks(seeds: DataFrame, splits: DataFrame) -> DataFrame:
    """Held-out frames that contributed a seed; empty when the hold-out is sound."""
    held = splits.where(F.col("split") == "heldout").select("frame_index")
    return seeds.select("frame_index").intersect(held)


# --- sampling ---------------------------------------------------------------------

def _smallest_per_stratum(frames: DataFrame, budget: Column, buckets: int = 64) -> DataFrame:
    """Frames with the ``budget`` smallest hash keys per stratum, ranked.

    A first cut inside hash buckets keeps every possible winner, so the final
    ranking sees at most budget x buckets rows per stratum.
    """
    local = Window.partitionBy("stratum", F.pmod(F.col("_key"), F.lit(buckets))).orderBy("_key", "frame_index")
    whole = Window.partitionBy("stratum").orderBy("_key", "frame_index")
    return (
        frames.withColumn("_local", F.row_number().over(local))
        .where(F.col("_local") <= budget)
        .withColumn("draw_order", F.row_number().over(whole))
        .where(F.col("draw_order") <= budget)
    )


def draw_key(frame: Column, seed: int) -> Column:
    """Seeded integer hash that orders frames for sampling."""
    x = F.pmod(frame.cast("bigint") * 48271 + F.lit(seed * 104729 + 12345), F.lit(2147483647))
    x = F.pmod(x * x, F.lit(2147483647))
    return F.pmod(x * 69621 + frame.cast("bigint"), F.lit(2147483647))


def replay_sample(frames: DataFrame, budget: int, seed: int) -> DataFrame:
    """Seeded sample of at most ``budget`` frames in shuffled order."""
    keyed = frames.select("frame_index", draw_key(F.col("frame_index"), seed).alias("_key"), F.lit(0).alias("stratum"))
    return _smallest_per_stratum(keyed, F.lit(budget)).select("frame_index", "draw_order")


def replay_sample_decay(frames: DataFrame, budget: int, seed: int) -> DataFrame:
    """Long-travel variant: half the budget, equally from the first 2/3 and the last 1/3."""
    positions = with_positions(
        frames.select("frame_index").withColumn("_b", F.shiftright("frame_index", 12)), [], "_b", [F.col("frame_index")]
    )
    total = frames.agg(F.floor(F.count(F.lit(1)) * 2 / 3).alias("_cut"))
    keyed = (
        attach(positions, total)
        .select(
            "frame_index",
            draw_key(F.col("frame_index"), seed).alias("_key"),
            (F.col("position") >= F.col("_cut")).cast("int").alias("stratum"),
        )
    )
    return _smallest_per_stratum(keyed, F.lit(budget // 2 // 2)).select("frame_index", "stratum", "draw_order")


def long_travel(poses: DataFrame, limit_m: float = 120.0) -> DataFrame:
    """Whether the last pose lies further than ``limit_m`` from the first."""
    place = F.struct("tx", "ty", "tz")
    ends = poses.agg(F.min_by(place, "frame_index").alias("a"), F.max_by(place, "frame_index").alias("b"))
    square = sum(((F.col(f"b.{n}") - F.col(f"a.{n}")) ** 2 for n in ("tx", "ty", "tz")), F.lit(0.0))
    return ends.select(F.sqrt(square).alias("travel_m"), (F.sqrt(square) > limit_m).alias("decay"))


def trajectory_resample(poses: DataFrame, frames_out: int) -> DataFrame:
    """Resample ordered poses to max(frames_out, count) evenly spaced positions.

    The output range comes from ``spark.range`` over the pose count, each position
    meets its two poses by an equi-join on the order index.
    """
    ordered = with_positions(
        poses.withColumn("_b", F.shiftright("frame_index", 12)), [], "_b", [F.col("frame_index")]
    ).drop("_b")
    count = F.col("_n")
    sizes = poses.agg(F.count(F.lit(1)).alias("_n"))
    out = F.greatest(F.lit(frames_out), count)
    # Source pose p owns the output positions i with floor(i * (n-1) / (m-1)) = p.
    owned = attach(ordered, sizes).withColumn("_m", out)
    first = F.ceil(F.col("position") * (F.col("_m") - 1) / F.greatest(count - 1, F.lit(1)) - 1e-9)
    last = F.least(
        F.ceil((F.col("position") + 1) * (F.col("_m") - 1) / F.greatest(count - 1, F.lit(1)) - 1e-9) - 1,
        F.col("_m") - 1,
    )
    single = count == 1
    start = F.when(single, F.lit(0)).otherwise(first)
    end = F.when(single, F.col("_m") - 1).otherwise(last)
    placed = owned.where(start <= end).withColumn("out_index", F.explode(F.sequence(start, end))).withColumn(
        "_at", F.when(single, F.lit(0.0)).otherwise(F.col("out_index") * (count - 1) / (F.col("_m") - 1))
    )
    right = ordered.select(
        (F.col("position") - 1).alias("position"), *[F.col(n).alias(f"r_{n}") for n in POSE]
    )
    joined = placed.join(right, "position", "left")
    amount = "(_at - position)"
    after = [f"r_{n}" for n in POSE]
    turned = with_slerp(joined, POSE[:4], after[:4], amount)
    mixed = [*[f"_s{i}" for i in range(4)], *lerp(POSE[4:], after[4:], amount)]
    return turned.selectExpr(
        "cast(out_index as int) as out_index",
        *[
            f"case when r_qw is null or {amount} < 1e-6D then {a} else {m} end as {a}"
            for a, m in zip(POSE, mixed)
        ],
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df

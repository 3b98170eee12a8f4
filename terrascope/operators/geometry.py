"""Point projection, depth rasters, temporal support and depth gates."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terrascope.functions.near import near_frames
from terrascope.functions.numeric import clip, count_when, finite, ratio
from terrascope.functions.single import attach
from terrascope.functions.rigid import (
    POSE,
    Intrinsics,
    columns,
    pose_matrix,
    pose_translation,
    rotate,
    to_camera,
    to_world,
    transpose,
    with_rotation,
)
from terrascope.operators.ordered import ROWS_PER_TASK, least_parts, parts_of, with_positions

XYZ = ("x", "y", "z")
CAMERA = ("xc", "yc", "zc")
PIXEL = ["frame_index", "u", "v"]
#: The word of a mask that holds a pixel, and the pixel's bit among its 64.
PIXEL_WORD = "shiftright(u, 6)"
PIXEL_BIT = "shiftleft(1L, cast(u & 63 as int))"


def snap(axis: str, size: int, rounding: str) -> tuple[str, str]:
    """(inside test, pixel) texts for a sub-pixel column under one of three rules.

    The tests compare the sub-pixel value itself, so rejected points are never
    rounded: half away from zero, half to even, and floor.
    """
    edge = size - 0.5
    if rounding == "half_away":
        return f"{axis} > -0.5D and {axis} < {edge}D", f"cast(floor({axis} + 0.5D) as int)"
    if rounding == "half_even":
        upper = "<=" if size % 2 else "<"
        return f"{axis} >= -0.5D and {axis} {upper} {edge}D", f"cast(rint({axis}) as int)"
    if rounding == "floor":
        return f"{axis} >= 0D and {axis} < {size}D", f"cast(floor({axis}) as int)"
    raise ValueError(f"unknown rounding: {rounding}")


def as_camera(df: DataFrame, camera: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Add xc, yc, zc from expression texts, each worked out once per row.

    Emitted through ``inline``: depth and image tests on the results then stay above
    this step. Pushed into the join below, every test would repeat the whole
    transform and the generated method would grow past what the JVM compiles.
    """
    fields = ", ".join(f"{text} as {name}" for text, name in zip(camera, CAMERA))
    return df.selectExpr(*keep, f"inline(array(struct({fields})))")


# --- projection ----------------------------------------------------------------------

def world_to_camera(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Add camera coordinates xc, yc, zc from the pose of the point's frame."""
    joined = points.where(finite(*[F.col(c) for c in XYZ])).join(
        with_rotation(poses.select("frame_index", *POSE)), "frame_index"
    )
    camera = to_camera(pose_matrix(), pose_translation(), XYZ)
    return as_camera(joined, camera, points.columns)


def pinhole(cam: DataFrame, k: Intrinsics, rounding: str = "half_away", depth_gate: bool = True) -> DataFrame:
    """Add sub-pixel (us, vs) and pixel (u, v); drop depths out of range and clip to the image."""
    gate = f"zc > {k.min_depth}D and zc <= {k.max_depth}D" if depth_gate else "zc <> 0D"
    placed = cam.where(gate).selectExpr(
        "*", f"{k.fx}D * xc / zc + {k.cx}D as us", f"{k.fy}D * yc / zc + {k.cy}D as vs"
    )
    inside_u, u = snap("us", k.width, rounding)
    inside_v, v = snap("vs", k.height, rounding)
    return placed.where(f"{inside_u} and {inside_v}").selectExpr("*", f"{u} as u", f"{v} as v")


def project_points(points: DataFrame, poses: DataFrame, k: Intrinsics, rounding: str = "half_away") -> DataFrame:
    return pinhole(world_to_camera(points, poses), k, rounding)


def nearest_z_pixel(
    projected: DataFrame, carry: Sequence[str], float32_depth: bool = True, keys: Sequence[str] = PIXEL
) -> DataFrame:
    """Nearest point per pixel with its depth and the ``carry`` columns.

    The depth buffer of the mapper holds FLOAT while candidates stay DOUBLE: among
    points that round to the smallest FLOAT, one below that value replaces its
    predecessor, so the last such point wins; without one the first point wins.
    ``float32_depth=False`` compares DOUBLE depths, first point on a tie.
    """
    if float32_depth:
        stored = F.col("zc").cast("float")
        above = F.col("zc") >= stored.cast("double")
        rank = F.struct(
            stored.alias("a"),
            above.cast("int").alias("b"),
            F.when(above, F.col("point_idx")).otherwise(-F.col("point_idx")).alias("c"),
        )
        depth = stored
    else:
        rank = F.struct(F.col("zc").alias("a"), F.col("point_idx").alias("c"))
        depth = F.col("zc")
    best = F.min_by(F.struct(depth.cast("double").alias("depth"), "point_idx", *carry), rank)
    return projected.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def label_projection(
    matches: DataFrame,
    scan_points: DataFrame,
    scan_poses: DataFrame,
    frame_poses: DataFrame,
    rotation: Sequence[Sequence[float]],
    translation: Sequence[float],
    k: Intrinsics,
) -> DataFrame:
    """Label raster of every matched frame from its labelled scan.

    Scan points pass the sensor extrinsic and the scan pose into the world, then the
    frame pose into the image; half-even pixels, nearest depth, label + 1.
    """
    r_cl = [[f"({float(x)!r}D)" for x in row] for row in rotation]
    t_cl = [f"({float(x)!r}D)" for x in translation]
    scans = with_rotation(scan_poses.select("scan_id", *[F.col(n).alias(f"s_{n}") for n in POSE]), "s_")
    paired = (
        matches.where(F.col("scan_id") >= 0)
        .select("frame_index", "scan_id")
        .join(with_rotation(frame_poses.select("frame_index", *POSE)), "frame_index")
        .join(scans, "scan_id")
    )
    # The chain sensor -> world -> camera becomes one 3x4 transform per view.
    columns_of = lambda m, j: [row[j] for row in m]
    turned = [rotate(pose_matrix("s_"), columns_of(r_cl, j)) for j in range(3)]
    moved = to_world(pose_matrix("s_"), pose_translation("s_"), t_cl)
    middle = [f"{turned[j][i]} as _w{i}{j}" for i in range(3) for j in range(3)]
    world = paired.selectExpr("*", *middle, *[f"{m} as _w{i}3" for i, m in enumerate(moved)])
    back = transpose(pose_matrix())
    whole = [rotate(back, [f"_w{i}{j}" for i in range(3)]) for j in range(3)]
    shift = to_camera(pose_matrix(), pose_translation(), [f"_w{i}3" for i in range(3)])
    views = world.selectExpr(
        "frame_index", "scan_id",
        *[f"{whole[j][i]} as v{i}{j}" for i in range(3) for j in range(3)],
        *[f"{m} as v{i}3" for i, m in enumerate(shift)],
    )
    cam = [f"v{i}0 * x + v{i}1 * y + v{i}2 * z + v{i}3" for i in range(3)]
    placed = as_camera(scan_points.join(views, "scan_id"), cam, ["frame_index", "point_idx", "label"])
    nearest = nearest_z_pixel(pinhole(placed, k, "half_even"), ["label"], float32_depth=False)
    return nearest.select(
        *PIXEL, "depth", (F.col("label") + 1).cast("int").alias("label"), F.lit(255).alias("conf_u8")
    )


def class_pixel_histogram(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pixels per class with zero rows for absent classes."""
    counts = labels.groupBy(F.col("label").alias("class_id")).agg(F.count(F.lit(1)).alias("pixels"))
    return classes.select("class_id").distinct().join(counts, "class_id", "left").select(
        "class_id", F.coalesce("pixels", F.lit(0)).alias("pixels")
    )


def labelled_pixel_summary(labels: DataFrame, matches: DataFrame) -> DataFrame:
    matched = matches.where(F.col("scan_id") >= 0).agg(F.count(F.lit(1)).alias("matched_frames"))
    pixels = labels.agg(F.count(F.lit(1)).alias("labelled_pixels"))
    return (
        attach(matched, pixels)
        .select(
            "matched_frames",
            "labelled_pixels",
            F.coalesce(ratio(F.col("labelled_pixels"), F.col("matched_frames")), F.lit(0.0)).alias("mean_pixels"),
        )
    )


def stride_sample(points: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th point of each cloud in cloud order, the first included.

    Places count inside blocks of a cloud, shifted by the sizes of its earlier blocks. A block's
    size is the place of its last point, so both sides of the join read one shuffle of the points.
    """
    if stride <= 1:
        return points
    # A struct is equal to itself with nulls inside, and the join keeps the partitions of the window.
    parts = parts_of(points)
    rows = points.withColumn("_part", F.struct("frame_index", F.shiftright("point_idx", 20).alias("block"))).repartition(parts, "_part")
    inside = Window.partitionBy("_part").orderBy("point_idx")
    placed = rows.withColumn("_place", F.row_number().over(inside)).withColumn("_end", F.lead(F.lit(1)).over(inside).isNull())
    earlier = Window.partitionBy("_part.frame_index").orderBy("_part.block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.where("_end").select("_part", "_place").repartition(parts, "_part.frame_index")
    before = blocks.select(F.col("_part").alias("_key"), F.coalesce(F.sum("_place").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(before, F.col("_part") == F.col("_key"))
    return joined.where((F.col("_before") + F.col("_place") - 1) % stride == 0).select(*points.columns)


def color_or_default(points: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Colour channels with white for absent columns and nulls."""
    filled = [
        F.coalesce(F.col(c), F.lit(255)).cast("int").alias(c) if c in points.columns else F.lit(255).alias(c)
        for c in channels
    ]
    return points.select(*[c for c in points.columns if c not in channels], *filled)


# --- temporal support -------------------------------------------------------------------

#: Points that one group of neighbouring frames holds, where frames are not larger than that.
POINTS_PER_GROUP = 1 << 17


def temporal_support(
    points: DataFrame,
    distance: float = 0.12,
    radius: int = 3,
    min_support: int = 3,
    min_gap: int = 2,
    bidirectional: bool = True,
    dynamic_max_support: int = 1,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Support of every point by other frames within ``radius``, and its class.

    A frame supports a point when any of its points lies within ``distance``. Points are
    shuffled once, into blocks of frames; the frames within ``radius`` before and after a
    block come along, with nothing but their places. Where blocks would hold many points,
    wide cells part them, and places within reach of a cell come along as well. Each group
    then finds the supporting frames of its own points as bits of one number
    (``near_frames``), so no join and no second shuffle is needed. Columns of ``points``
    travel with them: leave out what is not used. ``frames`` are the same points where their
    frames are cheaper to count.
    """
    if not 1 <= radius <= 31:
        raise ValueError("radius must be within 1..31")
    sizes = (points if frames is None else frames).groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    lo, hi, total, largest = sizes.agg(F.min("frame_index"), F.max("frame_index"), F.sum("n"), F.max("n")).first()
    offsets = [k for k in range(-radius, radius + 1) if k]
    block = max(2 * radius, min(64, max(16, POINTS_PER_GROUP // (largest or 1))))
    wide, reach = 16.0 * distance, distance * 1.001
    in_block = lambda f: F.floor(f / F.lit(float(block))).cast("bigint")
    in_cell = lambda value: F.floor(value / F.lit(wide)).cast("bigint")

    mine, keys = F.col("_block") == in_block(F.col("frame_index")), ["_block"]
    # Blocks before the first frame and after the last have no points of their own.
    first = in_block(F.greatest(F.col("frame_index") - radius, F.lit(lo)))
    last = in_block(F.least(F.col("frame_index") + radius, F.lit(hi)))
    copies = points.where(finite(*[F.col(c) for c in XYZ])).select("*", F.explode(F.sequence(first, last)).alias("_block"))
    if block * (largest or 0) > 4 * POINTS_PER_GROUP:
        for c in XYZ:
            copies = copies.select("*", F.explode(F.sequence(in_cell(F.col(c) - reach), in_cell(F.col(c) + reach))).alias(f"_c{c}"))
            mine, keys = mine & (F.col(f"_c{c}") == in_cell(F.col(c))), [*keys, f"_c{c}"]
    places = ["frame_index", *XYZ]
    rest = [c for c in points.columns if c not in places]
    copies = copies.withColumn("_mine", mine).select(*keys, *places, "_mine", *[F.when(F.col("_mine"), F.col(c)).alias(c) for c in rest])
    names, near = list(points.columns), near_frames(distance, radius)

    def run(group: pa.Table) -> pa.Table:
        own = group["_mine"].to_numpy()
        xyz = np.stack([group[c].cast(pa.float64()).to_numpy() for c in XYZ], axis=1)
        masks = near(group["frame_index"].to_numpy(), xyz, np.flatnonzero(own))
        return group.filter(group["_mine"]).select(names).append_column("_mask", pa.array(masks))

    parts = max(least_parts(points), -(-(total or 0) * (block + 2 * radius) // (block * ROWS_PER_TASK)))
    shape = StructType([*[points.schema[c] for c in names], StructField("_mask", LongType())])
    found = copies.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, shape)
    judged = found.select("*", F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi"), (F.bit_count("_mask") + 1).cast("int").alias("support"))
    past = sum(1 << (k + radius) for k in offsets if k <= -min_gap)
    future = sum(1 << (k + radius) for k in offsets if k >= min_gap)
    begin = F.greatest(F.col("frame_index") - radius, F.col("_lo"))
    end = F.least(F.col("frame_index") + radius, F.col("_hi"))
    needed = F.least(F.lit(min_support), end - begin + 1)
    two_sided = (
        F.lit(bidirectional)
        & (F.col("frame_index") >= begin + min_gap)
        & (end >= F.col("frame_index") + min_gap)
    )
    spans = ~two_sided | (
        (F.col("_mask").bitwiseAND(F.lit(past)) != 0) & (F.col("_mask").bitwiseAND(F.lit(future)) != 0)
    )
    return judged.withColumn("kept", (F.col("support") >= needed) & spans).select(
        *points.columns,
        "support",
        "kept",
        F.when(F.col("kept"), "static")
        .when(F.col("support") <= dynamic_max_support, "dynamic")
        .otherwise("uncertain")
        .alias("motion"),
    )


def temporal_filter_stats(supported: DataFrame, raw: DataFrame) -> DataFrame:
    """Input, kept and dynamic counts with the keep ratio, per frame and in total."""
    marks = raw.select("frame_index", F.lit(1).alias("i"), F.lit(0).alias("k"), F.lit(0).alias("d")).unionByName(
        supported.select(
            "frame_index",
            F.lit(0).alias("i"),
            F.col("kept").cast("int").alias("k"),
            (F.col("motion") == "dynamic").cast("int").alias("d"),
        )
    )
    return marks.rollup("frame_index").agg(
        F.sum("i").alias("input_points"),
        F.sum("k").alias("kept_points"),
        F.sum("d").alias("dynamic_points"),
        F.coalesce(ratio(F.sum("k"), F.sum("i")), F.lit(0.0)).alias("keep_ratio"),
    )


# --- masks and depth fusion ---------------------------------------------------------------

def disk_offsets(radius: float) -> list[tuple[int, int]]:
    reach = int(math.floor(radius))
    return [
        (du, dv)
        for dv in range(-reach, reach + 1)
        for du in range(-reach, reach + 1)
        if du * du + dv * dv <= radius * radius
    ]


def spread(pixels: DataFrame, offsets: Sequence[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Copy each row to (u + du, v + dv) inside the image, with the squared offset."""
    moves = F.expr(
        "array(" + ", ".join(f"struct({du} as _du, {dv} as _dv, {du * du + dv * dv} as offset2)" for du, dv in offsets) + ")"
    )
    rest = [c for c in pixels.columns if c not in ("u", "v")]
    return (
        pixels.select(*rest, "u", "v", F.inline(moves))
        .select(*rest, (F.col("u") + F.col("_du")).alias("u"), (F.col("v") + F.col("_dv")).alias("v"), "offset2")
        .where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    )


def dynamic_mask(projected_dynamic: DataFrame, radius: int, k: Intrinsics) -> DataFrame:
    """Pixels blanked around projected dynamic points, 64 of a row as the bits of one number, and the points seen in them.

    Pixels of one number meet before they are shuffled; a row per pixel never is.
    """
    near = spread(projected_dynamic.select(*PIXEL), disk_offsets(radius), k.width, k.height)
    return near.groupBy("frame_index", "v", F.expr(PIXEL_WORD).alias("word")).agg(
        F.bit_or(F.expr(PIXEL_BIT)).alias("bits"), F.count_if(F.col("offset2") == 0).alias("points")
    )


def dynamic_mask_stats(mask: DataFrame) -> DataFrame:
    """Projected points and blanked pixels per frame."""
    return mask.groupBy("frame_index").agg(F.sum("points").alias("projected_points"), F.sum(F.bit_count("bits")).alias("masked_pixels"))


def apply_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels that the mask does not blank."""
    words = mask.select("frame_index", "v", "word", "bits")
    found = pixels.withColumn("word", F.expr(PIXEL_WORD)).join(words.hint("merge"), ["frame_index", "v", "word"], "left")
    return found.where(f"coalesce(bits & {PIXEL_BIT}, 0L) = 0").select(*pixels.columns)


def accumulate_depth(
    points: DataFrame, poses: DataFrame, k: Intrinsics, frames_before: int, frames_after: int
) -> DataFrame:
    """Depth raster per frame from the clouds of neighbouring frames.

    A cloud meets the poses of all frames that read it at once, as a list of that many
    entries, so its points are moved once and no copy of a point is shuffled.
    """
    views = with_rotation(poses.select("frame_index", *POSE))
    readers = (
        views.select(
            F.explode(F.sequence(F.col("frame_index") - frames_before, F.col("frame_index") + frames_after)).alias("source"),
            F.struct(*views.columns).alias("_view"),
        )
        .groupBy("source")
        .agg(F.collect_list("_view").alias("_views"))
    )
    clouds = points.where(finite(*[F.col(c) for c in XYZ])).select(F.col("frame_index").alias("source"), *XYZ)
    sent = clouds.join(readers.hint("merge"), "source").select(*XYZ, F.inline("_views"))
    seen = pinhole(as_camera(sent, to_camera(pose_matrix(), pose_translation(), XYZ), ["frame_index"]), k)
    stored = F.col("zc").cast("float")
    # The FLOAT buffer rule of nearest_z_pixel only decides which point wins; the
    # stored depth is the smallest FLOAT either way.
    return seen.groupBy(*PIXEL).agg(
        F.min(stored).cast("double").alias("depth"), F.count(F.lit(1)).alias("points")
    )


def depth_accumulate_trailing(points: DataFrame, poses: DataFrame, k: Intrinsics, frames: int) -> DataFrame:
    return accumulate_depth(points, poses, k, frames - 1, 0)


def depth_fuse_symmetric(static_points: DataFrame, poses: DataFrame, k: Intrinsics, radius: int) -> DataFrame:
    return accumulate_depth(static_points, poses, k, radius, radius)


def bilinear_color(samples: DataFrame, raster: DataFrame, keys: Sequence[str], k: Intrinsics, channels: Sequence[str]) -> DataFrame:
    """Colour at sub-pixel (us, vs) from four clamped neighbours."""
    u0 = clip(F.floor(F.col("us")), 0, k.width - 1).cast("int")
    v0 = clip(F.floor(F.col("vs")), 0, k.height - 1).cast("int")
    based = samples.select(*keys, "us", "vs", u0.alias("_u0"), v0.alias("_v0"))
    u1, v1 = F.least(F.col("_u0") + 1, F.lit(k.width - 1)), F.least(F.col("_v0") + 1, F.lit(k.height - 1))
    du, dv = F.col("us") - F.col("_u0"), F.col("vs") - F.col("_v0")
    corners = F.array(
        F.struct(F.col("_u0").alias("u"), F.col("_v0").alias("v"), ((1.0 - du) * (1.0 - dv)).alias("w")),
        F.struct(u1.alias("u"), F.col("_v0").alias("v"), (du * (1.0 - dv)).alias("w")),
        F.struct(F.col("_u0").alias("u"), v1.alias("v"), ((1.0 - du) * dv).alias("w")),
        F.struct(u1.alias("u"), v1.alias("v"), (du * dv).alias("w")),
    )
    return (
        based.select(*keys, F.inline(corners))
        .join(raster.select(*PIXEL, *channels), PIXEL)
        .groupBy(*keys)
        .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in channels])
    )


# --- depth completion gates ---------------------------------------------------------------

def patch_holes(depths: DataFrame, patch: int) -> DataFrame:
    """Smallest predicted depth of every grid cell without a measurement."""
    offered = F.when(F.col("predicted") > 0, F.struct(F.col("predicted"), F.col("v"), F.col("u")))
    return (
        depths.groupBy(
            "frame_index",
            F.floor(F.col("v") / patch).cast("int").alias("patch_v"),
            F.floor(F.col("u") / patch).cast("int").alias("patch_u"),
        )
        .agg(F.max("measured").alias("_measured"), F.min(offered).alias("_pick"))
        .where((F.coalesce(F.col("_measured"), F.lit(0.0)) <= 0) & F.col("_pick").isNotNull())
        .select("frame_index", "patch_v", "patch_u", F.col("_pick.u").alias("u"), F.col("_pick.v").alias("v"), F.col("_pick.predicted").alias("predicted"))
    )


def completion_bias(depths: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per frame: mean of predicted - measured on known pixels and the verdict."""
    known = F.when(F.col("measured") > 0, F.col("predicted") - F.col("measured"))
    gate = depths.groupBy("frame_index").agg(F.count(known).alias("known_pixels"), F.avg(known).alias("bias"))
    return gate.withColumn("accepted", F.coalesce(F.abs("bias") < limit, F.lit(False)))


def completion_gate(depths: DataFrame, limit: float = 0.1) -> DataFrame:
    """Depths of accepted frames with the bias removed."""
    gate = completion_bias(depths, limit).where("accepted").select("frame_index", "bias")
    return depths.join(gate, "frame_index").withColumn("predicted", F.col("predicted") - F.col("bias")).drop("bias")


def densify(pixels: DataFrame, width: int, height: int, values: Sequence[str]) -> DataFrame:
    """Every pixel of every frame present; absent ones read 0."""
    grid = (
        pixels.select("frame_index")
        .distinct()
        .select("frame_index", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("v"))
        .select("frame_index", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("u"), "v")
    )
    return grid.join(pixels.select(*PIXEL, *values), PIXEL, "left").select(
        *PIXEL, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in values]
    )


def depth_edge_mask(depths: DataFrame, width: int, height: int, limit: float = 0.1) -> DataFrame:
    """3x3 Sobel magnitude of the predicted depth and whether it stays below the limit.

    Separable: one pass along u, one along v; the image border is mirrored without
    repeating the edge pixel. Rows are placed by frame once and both passes reuse it.
    """
    placed = densify(depths, width, height, ["predicted"]).repartition("frame_index")
    along_u = Window.partitionBy("frame_index", "v").orderBy("u")
    along_v = Window.partitionBy("frame_index", "u").orderBy("v")

    def pair(column: str, window: Window) -> tuple[Column, Column]:
        before, after = F.lag(column).over(window), F.lead(column).over(window)
        return F.coalesce(before, after), F.coalesce(after, before)

    left, right = pair("predicted", along_u)
    rows = placed.withColumn("_du", right - left).withColumn("_su", left + 2 * F.col("predicted") + right)
    up_d, down_d = pair("_du", along_v)
    up_s, down_s = pair("_su", along_v)
    return (
        rows.withColumn("_gx", up_d + 2 * F.col("_du") + down_d)
        .withColumn("_gy", down_s - up_s)
        .select(*PIXEL, "predicted", F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2).alias("gradient"))
        .withColumn("smooth", F.col("gradient") < limit)
    )


def backproject(pixels: DataFrame, poses: DataFrame, k: Intrinsics, depth: str = "predicted") -> DataFrame:
    """World position of pixels with depth in (0, max_depth]."""
    ray = [f"((u - {k.cx}D) * {depth} / {k.fx}D)", f"((v - {k.cy}D) * {depth} / {k.fy}D)", depth]
    joined = pixels.where(f"{depth} > 0 and {depth} <= {k.max_depth}D").join(
        with_rotation(poses.select("frame_index", *POSE)), "frame_index"
    )
    world = to_world(pose_matrix(), pose_translation(), ray)
    return joined.select(*pixels.columns, *columns(world, XYZ))


def lidar_proximity(candidates: DataFrame, depths: DataFrame, radius: float, k: Intrinsics) -> DataFrame:
    """Distance to the nearest measured pixel within ``radius``; null means rejected.

    Candidates look at a fixed disk of pixels, an equality join each.
    """
    looked = spread(candidates.select(*PIXEL, F.col("u").alias("_u"), F.col("v").alias("_v")), disk_offsets(radius), k.width, k.height)
    near = (
        looked.join(depths.where(F.col("measured") > 0).select(*PIXEL), PIXEL)
        .groupBy("frame_index", F.col("_u").alias("u"), F.col("_v").alias("v"))
        .agg(F.sqrt(F.min("offset2")).alias("lidar_distance"))
    )
    return candidates.join(near, PIXEL, "left").withColumn(
        "near_lidar", F.coalesce(F.col("lidar_distance") <= radius, F.lit(False))
    )


def keyframe_order(frames: DataFrame) -> DataFrame:
    """Zero-based order of keyframes."""
    return with_positions(
        frames.select("frame_index").distinct().withColumn("_b", F.shiftright("frame_index", 12)),
        [], "_b", [F.col("frame_index")], "keyframe_no",
    ).select("frame_index", "keyframe_no")


def keyframe_support_ring(frames: DataFrame, window: int) -> DataFrame:
    """For each keyframe the up to ``window`` keyframes before it."""
    ordered = keyframe_order(frames)
    earlier = ordered.select(F.col("frame_index").alias("support_frame"), F.col("keyframe_no").alias("_no"))
    return (
        ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("back"))
        .withColumn("_no", F.col("keyframe_no") - F.col("back"))
        .join(earlier, "_no")
        .select("frame_index", "support_frame", "back")
    )


def depth_support_count(
    candidates: DataFrame,
    depths: DataFrame,
    poses: DataFrame,
    ring: DataFrame,
    k: Intrinsics,
    radius: int,
    current_radius: int,
    absolute_tolerance: float,
    relative_tolerance: float,
    min_support: int,
) -> DataFrame:
    """Frames (own and earlier keyframes) measuring the candidate's depth nearby.

    candidates(candidate_id, frame_index, u, v, predicted, x, y, z).
    """
    measured = depths.where(F.col("measured") > 0).select(
        F.col("frame_index").alias("view"), "u", "v", F.col("measured")
    )
    own = candidates.select(
        "candidate_id", F.col("frame_index").alias("view"), "u", "v", F.col("predicted").alias("expected")
    )
    views = with_rotation(poses.select(F.col("frame_index").alias("view"), *POSE))
    moved = candidates.join(ring.select("frame_index", F.col("support_frame").alias("view")), "frame_index").join(
        views, "view"
    )
    cam = to_camera(pose_matrix(), pose_translation(), XYZ)
    placed = as_camera(moved, cam, ["candidate_id", "view"])
    earlier = pinhole(placed, k).select("candidate_id", "view", "u", "v", F.col("zc").alias("expected"))
    looked = spread(own, disk_offsets(current_radius), k.width, k.height).unionByName(
        spread(earlier, disk_offsets(radius), k.width, k.height)
    )
    tolerance = F.greatest(F.lit(absolute_tolerance), relative_tolerance * F.col("expected"))
    hits = (
        looked.join(measured, ["view", "u", "v"])
        .where(F.abs(F.col("measured") - F.col("expected")) <= tolerance)
        .groupBy("candidate_id")
        .agg(F.count_distinct("view").alias("support"))
    )
    return candidates.join(hits, "candidate_id", "left").select(
        *candidates.columns, F.coalesce("support", F.lit(0)).alias("support")
    ).withColumn("supported", F.col("support") >= min_support)


def completion_counters(gates: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attempts to added points, per frame and in total.

    gates(frame_index, accepted); candidates(frame_index, near_lidar, supported, masked).
    """
    zero = F.lit(0).cast("bigint")
    names = ("attempts", "accepted", "rejected", "candidates", "proximity_rejected", "support_rejected", "added")
    frames = gates.select(
        "frame_index",
        F.lit(1).cast("bigint").alias("attempts"),
        F.col("accepted").cast("bigint").alias("accepted"),
        (~F.col("accepted")).cast("bigint").alias("rejected"),
        *[zero.alias(n) for n in names[3:]],
    )
    near, good = F.col("near_lidar"), F.col("supported")
    found = candidates.select(
        "frame_index",
        *[zero.alias(n) for n in names[:3]],
        F.lit(1).cast("bigint").alias("candidates"),
        (~near).cast("bigint").alias("proximity_rejected"),
        (near & ~good).cast("bigint").alias("support_rejected"),
        (near & good).cast("bigint").alias("added"),
    )
    return frames.unionByName(found).rollup("frame_index").agg(*[F.sum(n).alias(n) for n in names])


# --- map insertion --------------------------------------------------------------------------

def hole_insertion(
    cam: DataFrame, alpha: DataFrame, k: Intrinsics, alpha_limit: float = 0.99, carry: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Nearest point per floor pixel with its verdict ``inserted``.

    The nearest-depth choice precedes the image and sign tests, so a point behind the
    camera can take a pixel; ``strict`` removes those first. ``own_depth`` is the
    depth in the frame that measured the point.
    """
    usable = cam.where(F.col("zc") > 0) if strict else cam
    depth = F.col("zc").cast("float")

    def pixel(f: float, c: float, x: str) -> Column:
        # FLOAT arithmetic throughout; division yields DOUBLE and is rounded back.
        ray = f"cast(cast({x} as float) * cast({f} as float) / cast(zc as float) as float)"
        return F.expr(f"cast(floor(cast({ray} + cast({c} as float) as double)) as bigint)")

    pixelled = usable.where(depth != 0).select(
        "frame_index", "point_idx", "own_depth", *carry, depth.alias("_d"),
        pixel(k.fx, k.cx, "xc").alias("u"), pixel(k.fy, k.cy, "yc").alias("v"),
    )
    best = F.min_by(F.struct("_d", "point_idx", "own_depth", *carry), F.struct("_d", "point_idx"))
    nearest = pixelled.groupBy(*PIXEL).agg(best.alias("_b")).select(*PIXEL, "_b.*")
    inside = F.col("u").between(0, k.width - 1) & F.col("v").between(0, k.height - 1)
    joined = nearest.join(alpha.select(*PIXEL, F.col("alpha").alias("_alpha")), PIXEL, "left")
    open_pixel = F.coalesce(F.col("_alpha"), F.lit(0.0)) < alpha_limit
    return joined.select(
        *PIXEL, "point_idx", F.col("own_depth"), *carry,
        (inside & (F.col("own_depth") > 0) & open_pixel).alias("inserted"),
    )


def insertion_counters(cam: DataFrame, placed: DataFrame) -> DataFrame:
    seen = cam.groupBy("frame_index").agg(F.count(F.lit(1)).alias("input_points"))
    chosen = placed.groupBy("frame_index").agg(
        F.count(F.lit(1)).alias("nearest_z"), count_when(F.col("inserted")).alias("inserted")
    )
    return seen.join(chosen, "frame_index", "left").select(
        "frame_index", "input_points",
        F.coalesce("nearest_z", F.lit(0)).alias("nearest_z"),
        (F.coalesce("nearest_z", F.lit(0)) - F.coalesce("inserted", F.lit(0))).alias("rejected"),
        F.coalesce("inserted", F.lit(0)).alias("inserted"),
    )


SH_DC = 0.28209479177387814  # fixed value: degree-0 spherical harmonic


def seed_attributes(
    points: DataFrame, k: Intrinsics, scaling: float = 1.0, logit_scale: float = 4.0,
    channels: Sequence[str] = ("r", "g", "b"),
) -> DataFrame:
    """Initial attributes of new map points; colour channels in [0, 1]."""
    focal = (k.fx + k.fy) / 2.0
    return points.select(
        *points.columns,
        F.log(scaling * F.col("own_depth") / focal).alias("log_scale"),
        *[((F.col(c) - 0.5) / SH_DC).alias(f"dc_{c}") for c in channels],
        F.lit(math.log(0.1 / 0.9)).alias("opacity_logit"),
        F.lit(1.0).alias("rot_w"), F.lit(0.0).alias("rot_x"), F.lit(0.0).alias("rot_y"), F.lit(0.0).alias("rot_z"),
        (clip(F.col("conf"), 0.0, 1.0) * logit_scale).alias("class_strength"),
    )


def incidence_weight(
    depths: DataFrame, k: Intrinsics, power: float, floor_weight: float,
    absolute_tolerance: float, relative_tolerance: float,
) -> DataFrame:
    """Pixel weight from the angle between surface normal and view ray.

    Neighbours come from range windows one pixel wide, so absent pixels count as
    unmeasured. Both passes share one placement by frame.
    """
    placed = depths.select(*PIXEL, F.col("depth")).repartition("frame_index")
    along_u = Window.partitionBy("frame_index", "v").orderBy("u")
    along_v = Window.partitionBy("frame_index", "u").orderBy("v")

    def beside(window: Window, step: int) -> Column:
        return F.coalesce(F.first("depth").over(window.rangeBetween(step, step)), F.lit(0.0))

    near = (
        placed.withColumn("_l", beside(along_u, -1)).withColumn("_r", beside(along_u, 1))
        .withColumn("_t", beside(along_v, -1)).withColumn("_b", beside(along_v, 1))
    )

    def point(du: int, dv: int, d: Column) -> list[Column]:
        return [(F.col("u") + du - k.cx) * d / k.fx, (F.col("v") + dv - k.cy) * d / k.fy, d]

    center = point(0, 0, F.col("depth"))
    tu = [a - b for a, b in zip(point(1, 0, F.col("_r")), point(-1, 0, F.col("_l")))]
    tv = [a - b for a, b in zip(point(0, 1, F.col("_b")), point(0, -1, F.col("_t")))]
    normal = [tu[1] * tv[2] - tu[2] * tv[1], tu[2] * tv[0] - tu[0] * tv[2], tu[0] * tv[1] - tu[1] * tv[0]]
    length = lambda a: F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    prepared = near.withColumn("_nn", length(normal)).withColumn("_vn", length(center)).withColumn(
        "_dot", F.abs(normal[0] * center[0] + normal[1] * center[1] + normal[2] * center[2])
    )
    cosine = F.least(F.col("_dot") / F.greatest(F.col("_nn") * F.col("_vn"), F.lit(1e-8)), F.lit(1.0))
    sides = [F.col(c) for c in ("_l", "_r", "_t", "_b")]
    jump = F.greatest(*[F.abs(s - F.col("depth")) for s in sides])
    tolerance = F.greatest(F.lit(absolute_tolerance), F.abs("depth") * relative_tolerance)
    border = F.col("u").isin(0, k.width - 1) | F.col("v").isin(0, k.height - 1)
    reliable = (
        ~border & (F.col("depth") > 0) & (F.least(*sides) > 0)
        & (F.col("_nn") > 1e-8) & (F.col("_vn") > 1e-8) & (jump <= tolerance)
    )
    weight = F.when(reliable, floor_weight + (1.0 - floor_weight) * F.pow(cosine, F.lit(power))).otherwise(
        F.lit(floor_weight)
    )
    return prepared.select(*PIXEL, "depth", weight.alias("weight"), reliable.alias("reliable"))


def restrict_weight(weights: DataFrame, labels: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Weight 1 for pixels whose class is not listed."""
    listed = F.col("ref").isin([int(c) for c in classes])
    return weights.join(labels.select(*PIXEL, "ref"), PIXEL).withColumn(
        "weight", F.when(listed, F.col("weight")).otherwise(F.lit(1.0))
    )


def depth_consistency_gate(
    cam: DataFrame, surface: DataFrame, k: Intrinsics, class_count: int,
    absolute_tolerance: float, relative_tolerance: float,
) -> DataFrame:
    """Observation rows with the verdict ``valid``; surface has depth, ref, conf."""
    seen = pinhole(cam.where(F.col("zc") > 0), k, "half_even", depth_gate=False)
    joined = seen.join(surface.select(*PIXEL, "depth", "ref", "conf"), PIXEL, "left")
    tolerance = F.greatest(F.lit(absolute_tolerance), F.abs("depth") * relative_tolerance)
    valid = (
        (F.col("depth") > 0)
        & (F.abs(F.col("zc") - F.col("depth")) <= tolerance)
        & F.col("ref").between(1, class_count - 1)
        & (F.col("conf") > 0)
    )
    return joined.withColumn("valid", F.coalesce(valid, F.lit(False)))


def clamp_columns(points: DataFrame, max_scale: float, max_norm: float) -> DataFrame:
    """Cap the log-scale and rescale the latent vector to a largest norm."""
    from terrascope.functions.vectors import limit_norm

    return points.withColumn("log_scale", F.least("log_scale", F.lit(math.log(max_scale)))).withColumn(
        "latent", limit_norm(F.col("latent"), max_norm)
    )

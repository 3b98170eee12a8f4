"""Region maps, masks and pixel neighbourhoods."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.numeric import clip, count_when, ratio
from terrascope.functions.single import attach
from terrascope.operators.geometry import PIXEL, densify
from terrascope.operators.ordered import exact_percentiles

TILE = 8  # an 8 x 8 tile fits the 64 bits of one number


def area_rank(masks: DataFrame) -> DataFrame:
    """Zero-based paint order: larger masks first. A frame holds its masks only."""
    order = Window.partitionBy("frame_index").orderBy(F.col("area").desc(), "mask_id")
    return masks.withColumn("mask_order", (F.row_number().over(order) - 1).cast("int"))


def paint_regions(mask_pixels: DataFrame) -> DataFrame:
    """Exclusive region of every covered pixel: the mask painted last wins."""
    return mask_pixels.groupBy(*PIXEL).agg(F.max("mask_order").alias("region"))


def paint_raster(mask_pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Whole raster with -1 on uncovered pixels.

    A frame's canvas is painted first, like a mask of its own, so no join meets the pixels.
    """
    at = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    canvas = mask_pixels.select("frame_index").distinct().select("frame_index", at(height).alias("v")).select("frame_index", at(width).alias("u"), "v")
    inside = F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)
    painted = mask_pixels.where(inside).select(*PIXEL, F.col("mask_order").cast("int").alias("mask_order"))
    return paint_regions(painted.unionByName(canvas.withColumn("mask_order", F.lit(-1))))


def mask_tiles(mask_pixels: DataFrame) -> DataFrame:
    """Masks as 64-bit tiles, one bit per pixel."""
    return mask_pixels.groupBy(
        "frame_index", "mask_id",
        F.floor(F.col("u") / TILE).cast("int").alias("tile_u"), F.floor(F.col("v") / TILE).cast("int").alias("tile_v"),
    ).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(v, {TILE}) * {TILE} + pmod(u, {TILE}) as int))")).alias("bits"))


def mask_nms(
    masks: DataFrame, mask_pixels: DataFrame, iou_threshold: float, score_threshold: float, inner_threshold: float
) -> DataFrame:
    """Masks with the verdict ``keep`` of IoU, score and containment suppression.

    Each pair acts on its later mask, containment of the later one in reverse acts on
    the earlier; the last triangle also reads the first superdiagonal.

    Equal masks of a frame form one shape. Only shapes meet, on shared 64-bit tiles;
    a mask then needs from each other shape no more than its first and last rank, so
    a crowd of copies costs one row per copy and neighbouring shape, never a pair of
    copies.
    """
    by_score = Window.partitionBy("frame_index").orderBy(F.col("score").desc(), "mask_id")
    # Pixels are spread from few bytes, so everything made of them is estimated far too small:
    # none of it is broadcast.
    tiles = mask_tiles(mask_pixels)
    # A mask has at most one entry per tile of the image.
    outline = F.transform(
        F.array_sort(F.collect_list(F.struct("tile_u", "tile_v", "bits"))),
        lambda e: F.concat_ws(":", e["tile_u"], e["tile_v"], e["bits"]),
    )
    shapes = tiles.groupBy("frame_index", "mask_id").agg(
        F.sum(F.bit_count("bits")).alias("area"), F.sha2(F.array_join(outline, ","), 256).alias("shape")
    )
    members = (
        masks.select("frame_index", "mask_id", "score")
        .join(shapes.hint("merge"), ["frame_index", "mask_id"], "left")
        .select(
            "frame_index", "mask_id", "score", F.coalesce("area", F.lit(0)).alias("area"), "shape",
            F.row_number().over(by_score).alias("rank"), F.lag("shape").over(by_score).alias("shape_before"),
        )
    )
    groups = members.where(F.col("shape").isNotNull()).groupBy("frame_index", "shape").agg(
        F.min("mask_id").alias("mask_id"), F.max("area").alias("area"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
    )
    placed = tiles.join(groups.select("frame_index", "mask_id", "shape").hint("merge"), ["frame_index", "mask_id"])
    side = lambda t: placed.select(
        "frame_index", "tile_u", "tile_v", F.col("shape").alias(f"shape_{t}"), F.col("bits").alias(f"bits_{t}")
    )
    overlaps = (
        side("a").join(side("b").hint("merge"), ["frame_index", "tile_u", "tile_v"])
        .where(F.col("shape_a") != F.col("shape_b"))
        .groupBy("frame_index", F.col("shape_a").alias("shape"), F.col("shape_b").alias("other"))
        .agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).alias("shared"))
        .where(F.col("shared") > 0)
        .join(
            groups.select(
                "frame_index", F.col("shape").alias("other"), F.col("area").alias("other_area"), "first_rank", "last_rank"
            ).hint("merge"),
            ["frame_index", "other"],
        )
    )
    met = members.join(overlaps.hint("merge"), ["frame_index", "shape"]).select(
        "*", (F.col("shared") / F.col("area")).alias("_own"), (F.col("shared") / F.col("other_area")).alias("_other")
    )
    zero = F.lit(0.0)
    contained = 1.0 - F.col("_own") * F.col("_other")
    after = F.col("first_rank") < F.col("rank")
    before = F.col("last_rank") > F.col("rank")
    inside = after & (F.col("_other") < 0.5) & (F.col("_own") >= 0.85)
    around = before & (F.col("_own") >= 0.85) & (F.col("_other") < 0.5)
    next_to = inside & (F.col("shape_before") == F.col("other"))
    union = F.col("area") + F.col("other_area") - F.col("shared")
    worst = met.groupBy("frame_index", "mask_id").agg(
        F.max(F.when(after, F.col("shared") / union).otherwise(zero)).alias("_iou"),
        F.max(F.when(inside, contained).otherwise(zero)).alias("upper"),
        F.max(F.when(around | next_to, contained).otherwise(zero)).alias("lower"),
    )
    copies = groups.select("frame_index", "shape", F.col("first_rank").alias("_first"))
    judged = (
        members.join(copies.hint("merge"), ["frame_index", "shape"], "left")
        .join(worst.hint("merge"), ["frame_index", "mask_id"], "left")
        .select(
            "frame_index", "mask_id", "score", "rank", "area",
            F.when(F.col("rank") > F.col("_first"), F.lit(1.0)).otherwise(F.coalesce("_iou", zero)).alias("iou"),
            F.coalesce("upper", zero).alias("upper"), F.coalesce("lower", zero).alias("lower"),
        )
    )
    limit = 1.0 - inner_threshold
    tests = judged.select(
        "*",
        (F.col("iou") <= iou_threshold).alias("_iou"),
        (F.col("score") > score_threshold).alias("_score"),
        (F.col("upper") <= limit).alias("_upper"),
        (F.col("lower") <= limit).alias("_lower"),
    )
    frame = Window.partitionBy("frame_index")
    top = F.col("rank") <= 3
    # When a predicate rejects every mask of the frame, its three best pass it.
    rescued = [
        F.col(c) | (top & ~F.max(F.col(c)).over(frame)) for c in ("_score", "_upper", "_lower")
    ]
    keep = F.col("_iou") & rescued[0] & rescued[1] & rescued[2]
    return tests.withColumn("keep", keep).drop("_iou", "_score", "_upper", "_lower")


def area_stats(areas: DataFrame, image_pixels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, median, 90th percentile, maximum and median share of areas."""
    plain = areas.groupBy(*keys).agg(
        F.count("area").alias("regions"), F.min("area").alias("area_min"), F.max("area").alias("area_max")
    )
    ranked = exact_percentiles(
        areas, keys, "area", {"area_median": 0.5, "area_p90": 0.9}, F.floor(F.col("_value") / 256).cast("bigint")
    )
    joined = (
        plain.join(ranked, list(keys), "left")
        if keys
        else attach(plain, ranked)
    )
    return joined.withColumn("median_fraction", F.col("area_median") / image_pixels)


def joint_partition(levels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Region id of the distinct tuple of level ids, in lexicographic order per frame."""
    covered = F.greatest(*[F.col(n) for n in names]) >= 0
    order = Window.partitionBy("frame_index").orderBy(*[F.col(n) for n in names])
    tuples = (
        levels.where(covered).select("frame_index", *names).distinct()
        .withColumn("joint", (F.row_number().over(order) - 1).cast("int"))
    )
    keys = ["frame_index", *names]
    inside = levels.where(covered).join(tuples, keys)
    return inside.select(*levels.columns, "joint").unionByName(
        levels.where(~covered).withColumn("joint", F.lit(-1))
    )


def pixel_coverage(regions: DataFrame) -> DataFrame:
    """Share of pixels with a region per frame, and its mean over frames as frame -1."""
    covered = (F.col("region") >= 0).cast("double")
    frames = regions.groupBy("frame_index").agg(F.avg(covered).alias("coverage"))
    return frames.unionByName(
        frames.agg(F.avg("coverage").alias("coverage")).select(F.lit(-1).alias("frame_index"), "coverage")
    )


# Source label groups of each superclass (source ids are +1, 0 = unknown).
SUPERCLASS_GROUPS = {
    1: [7, 11, 14, 17, 19, 20],
    2: [3, 18, 21],
    3: [25, 26],
    4: [1, 8],
    5: [9, 10, 16, 23],
    6: [27, 28, 29],
    7: [15],
    8: [2],
    9: [4, 6, 22, 24],
    10: [5],
    11: [12, 13],
}


def label_remap(pixels: DataFrame, groups: dict[int, list[int]], source: str = "label", target: str = "superclass") -> DataFrame:
    """Many-to-one class map; labels outside every group become 0.

    The map is a few literals, so it is a row expression and needs no join.
    """
    expression: Column = F.lit(0)
    for superclass, labels in groups.items():
        expression = F.when(F.col(source).isin(labels), F.lit(superclass)).otherwise(expression)
    return pixels.withColumn(target, expression)


def region_boundaries(regions: DataFrame) -> DataFrame:
    """Mark pixels whose covered 4-neighbour belongs to another region.

    Only covered pixels are read; rows are placed by frame once for both directions.
    """
    placed = regions.where(F.col("region") >= 0).select(*PIXEL, "region").repartition("frame_index")

    def differs(axis: str, other: str, step: int) -> Column:
        window = Window.partitionBy("frame_index", other).orderBy(axis).rangeBetween(step, step)
        return F.coalesce(F.first("region").over(window) != F.col("region"), F.lit(False))

    edge = differs("u", "v", -1) | differs("u", "v", 1) | differs("v", "u", -1) | differs("v", "u", 1)
    return placed.withColumn("boundary", edge)


def focus_bounds(pixels: DataFrame, minimum_side: int, width: int, height: int) -> DataFrame:
    """Square crop around the pixels of each class, clamped to the image."""
    box = pixels.groupBy("frame_index", F.col("ref").alias("class_id")).agg(
        F.min("u").alias("_u0"), F.max("u").alias("_u1"), F.min("v").alias("_v0"), F.max("v").alias("_v1")
    )
    span = F.least(
        F.greatest(F.lit(minimum_side), F.col("_u1") - F.col("_u0") + 1, F.col("_v1") - F.col("_v0") + 1),
        F.lit(height), F.lit(width),
    )

    def start(low: str, high: str, size: int) -> Column:
        raw = F.rint(0.5 * (F.col(low) + F.col(high)) - F.col("span") / 2)
        return F.least(F.greatest(raw, F.lit(0.0)), (F.lit(size) - F.col("span")).cast("double")).cast("int")

    sized = box.withColumn("span", span)
    placed = sized.withColumn("x0", start("_u0", "_u1", width)).withColumn("y0", start("_v0", "_v1", height))
    return placed.select(
        "frame_index", "class_id", "x0", "y0", (F.col("x0") + F.col("span")).alias("x1"), (F.col("y0") + F.col("span")).alias("y1")
    )


def error_code(pixels: DataFrame) -> DataFrame:
    """0 no reference, 1 uncovered, 2 covered but wrong, 3 correct."""
    covered = F.col("region") >= 0
    code = (
        F.when(~F.col("reference_valid"), 0)
        .when(~covered, 1)
        .when(F.col("oracle") != F.col("ref"), 2)
        .otherwise(3)
    )
    return pixels.withColumn("error_code", code)


def error_code_summary(coded: DataFrame) -> DataFrame:
    reference = count_when(F.col("error_code") > 0)
    covered = count_when(F.col("error_code") >= 2)
    right = count_when(F.col("error_code") == 3)
    return coded.groupBy("frame_index").agg(
        reference.alias("reference_pixels"),
        covered.alias("covered_pixels"),
        right.alias("correct_pixels"),
        F.coalesce(ratio(covered, reference), F.lit(0.0)).alias("coverage"),
        F.coalesce(ratio(right, covered), F.lit(0.0)).alias("covered_accuracy"),
    )


# --- responses -----------------------------------------------------------------------------

def box_smooth(responses: DataFrame, width: int, height: int, keys: Sequence[str] = ("frame_index",), half: int = 14) -> DataFrame:
    """0.5 * (x + box mean) with zero padding and the full window as divisor.

    Separable sums over u, then over v; a window spans one image row or column.
    """
    side = 2 * half + 1
    placed = densify(responses, width, height, ["response"]).repartition(*keys)
    rows = Window.partitionBy(*keys, "v").orderBy("u").rangeBetween(-half, half)
    columns = Window.partitionBy(*keys, "u").orderBy("v").rangeBetween(-half, half)
    pooled = placed.withColumn("_row", F.sum("response").over(rows)).withColumn("_box", F.sum("_row").over(columns))
    return pooled.select(*keys, "u", "v", "response", (0.5 * (F.col("response") + F.col("_box") / (side * side))).alias("smooth"))


def query_response_stats(responses: DataFrame, alpha_limit: float = 0.05) -> DataFrame:
    """Range of responses per frame and query over visible pixels."""
    return (
        responses.where(F.col("alpha") > alpha_limit)
        .groupBy("frame_index", "query_id")
        .agg(
            F.count(F.lit(1)).alias("valid_pixels"),
            F.min("response").alias("response_min"),
            F.avg("response").alias("response_mean"),
            F.max("response").alias("response_max"),
            (F.max("response") - F.min("response")).alias("response_range"),
        )
    )


def minmax_heat(pixels: DataFrame, responses: dict[int, str], alpha_limit: float = 0.05) -> DataFrame:
    """clamp(2 (x - min) / (max - min + 1e-9) - 1, 0, 1) per frame and query, 0 where invisible.

    ``pixels``: frame_index, u, v, alpha and a column of responses per query, ``{query_id: column}``.
    The extremes are aggregated and joined back, so no frame is sorted or buffered. A pixel
    becomes a row per query only after the join. Frames without a visible pixel have no rows.
    """
    visible = F.col("alpha") > alpha_limit
    rows = pixels.select("frame_index", "u", "v", "alpha", *[F.col(c).alias(f"_x{q}") for q, c in responses.items()])
    # No filter on visible pixels: both sides of the join then read one shuffle.
    seen = {q: F.when(visible, F.col(f"_x{q}")) for q in responses}
    ends = rows.groupBy("frame_index").agg(
        F.count_if(visible).alias("_seen"), *[F.min(x).alias(f"_lo{q}") for q, x in seen.items()], *[F.max(x).alias(f"_hi{q}") for q, x in seen.items()]
    ).where("_seen > 0")

    def heat(q: int) -> Column:
        scaled = clip(2.0 * (F.col(f"_x{q}") - F.col(f"_lo{q}")) / (F.col(f"_hi{q}") - F.col(f"_lo{q}") + 1e-9) - 1.0, 0.0, 1.0)
        return F.struct(F.lit(q).alias("query_id"), F.when(visible, scaled).otherwise(F.lit(0.0)).alias("heat"))

    return rows.join(ends, "frame_index").select("frame_index", "u", "v", F.inline(F.array(*[heat(q) for q in responses])))


# --- training terms as metrics --------------------------------------------------------------

def class_balance_weights(pixels: DataFrame, power: float, cap: float, class_ids: Sequence[int]) -> DataFrame:
    """Balancing factor per frame and class from the weighted histogram; absent -> 0."""
    names = [f"h_{c}" for c in class_ids]
    histogram = pixels.groupBy("frame_index").agg(
        *[F.coalesce(F.sum(F.when(F.col("ref") == c, F.col("weight"))), F.lit(0.0)).alias(n) for c, n in zip(class_ids, names)]
    )
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    present = sum(((F.col(n) > 0).cast("int") for n in names[1:]), (F.col(names[0]) > 0).cast("int"))
    mean = total / F.greatest(present, F.lit(1))
    rows = F.array(*[F.struct(F.lit(int(c)).alias("class_id"), F.col(n).alias("histogram")) for c, n in zip(class_ids, names)])
    factor = F.least(F.pow(F.col("_mean") / F.greatest("histogram", F.lit(1e-6)), F.lit(power)), F.lit(cap))
    return (
        histogram.select("frame_index", mean.alias("_mean"), F.inline(rows))
        .select("frame_index", "class_id", "histogram", F.when(F.col("histogram") > 0, factor).otherwise(F.lit(0.0)).alias("balance"))
    )


def neighbour_coherence(pixels: DataFrame, stride: int) -> DataFrame:
    """Weighted mean probability gap between equal-label pixels ``stride`` apart.

    pixels(frame_index, u, v, ref, weight, probs). Each pair is met once, from its
    later pixel, by a range window of a single offset.
    """
    placed = pixels.select(*PIXEL, F.struct("ref", "weight", "probs").alias("p")).repartition("frame_index")

    def earlier(axis: str, other: str) -> Column:
        window = Window.partitionBy("frame_index", other).orderBy(axis).rangeBetween(-stride, -stride)
        return F.first("p").over(window)

    paired = placed.withColumn("_h", earlier("u", "v")).withColumn("_v", earlier("v", "u"))
    sides = paired.select("frame_index", "p", F.explode(F.array("_h", "_v")).alias("q")).where(
        F.col("q").isNotNull() & (F.col("q.ref") == F.col("p.ref"))
    )
    gap = F.aggregate(
        F.zip_with("p.probs", "q.probs", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x
    ) / F.size("p.probs")
    weight = F.least(F.col("p.weight"), F.col("q.weight"))
    return sides.groupBy("frame_index").agg(
        F.sum(weight).alias("pair_weight"), ratio(F.sum(weight * gap), F.sum(weight)).alias("coherence_gap")
    )


def weighted_cross_entropy(pixels: DataFrame, class_count: int) -> DataFrame:
    """Weighted mean cross entropy of the target class per frame.

    pixels(frame_index, ref, weight, alpha, static, logits[class_count]).
    """
    from terrascope.functions.vectors import log_softmax_at

    valid = F.col("ref").between(1, class_count - 1) & (F.col("alpha") > 0.05) & F.col("static")
    weight = F.when(valid, F.col("weight")).otherwise(F.lit(0.0))
    return (
        pixels.withColumn("_w", weight)
        .where(F.col("_w") > 0)
        .withColumn("_ce", -log_softmax_at(F.col("logits"), F.col("ref")))
        .groupBy("frame_index")
        .agg(F.sum("_w").alias("weight_sum"), ratio(F.sum(F.col("_w") * F.col("_ce")), F.sum("_w")).alias("cross_entropy"))
    )


def masked_image_error(pixels: DataFrame) -> DataFrame:
    """L1 on static pixels, depth L1 on static pixels with both depths."""
    static = F.col("static")
    both = static & (F.col("gt_depth") > 0) & (F.col("depth") > 0)
    return pixels.groupBy("frame_index").agg(
        F.avg(F.when(static, F.abs(F.col("color") - F.col("gt_color")))).alias("color_l1"),
        F.avg(F.when(both, F.abs(F.col("depth") - F.col("gt_depth")))).alias("depth_l1"),
        count_when(both).alias("depth_pixels"),
    )


def excluded_label_counts(pixels: DataFrame, excluded: Sequence[int], min_confidence: float = 0.35) -> DataFrame:
    """Confident pixels of the excluded classes, zero rows included."""
    confident = pixels.where((F.col("conf_u8") / 255.0 >= min_confidence) & F.col("ref").isin([int(c) for c in excluded]))
    counts = confident.groupBy(F.col("ref").alias("class_id")).agg(F.count(F.lit(1)).alias("pixels"))
    listed = pixels.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(c)) for c in excluded])).alias("class_id"))
    return listed.join(counts, "class_id", "left").select("class_id", F.coalesce("pixels", F.lit(0)).alias("pixels"))

"""Evaluation of a labelling chain: domains, oracles, confusion, metrics, AP.

Pixel tables are scanned once and reduced to counts as early as possible; every
metric is then derived from counts, whose size depends on frames, regions and
classes but not on pixels.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.numeric import count_when, ratio
from terrascope.operators.ordered import float_bucket, with_running_sums



def is_class(column: Column, class_ids: Sequence[int]) -> Column:
    return column.isin([int(c) for c in class_ids])


def class_position(column: Column, class_ids: Sequence[int]) -> Column:
    """Zero-based position of a class in the evaluation order, -1 when absent."""
    return F.array_position(F.array(*[F.lit(int(c)) for c in class_ids]), column.cast("int")).cast("int") - 1


# --- domains ---------------------------------------------------------------------

def reference_domain(pixels: DataFrame, class_ids: Sequence[int], min_confidence: float = 0.35) -> DataFrame:
    """Keep pixels of a primary class whose confidence/255 reaches the bound."""
    return pixels.where(
        is_class(F.col("ref"), class_ids) & (F.col("conf_u8") / 255.0 >= min_confidence)
    )


def domain_masks(stages: DataFrame) -> DataFrame:
    """Tag every pixel with its domains; ``stages`` is an array of stage structs.

    All stages of a pixel sit in one row, so the intersection of their valid masks
    is a row expression and no pixel moves.
    """
    common = F.forall("stages", lambda s: s["valid"])
    tags = F.when(common, F.array(F.lit("full_reference"), F.lit("common_valid"))).otherwise(
        F.array(F.lit("full_reference"))
    )
    return stages.select("*", F.explode(tags).alias("domain"))


def stage_structs(stages: dict[str, tuple[Column, Column]]) -> Column:
    """Array of (stage, order, pred, valid) built from per-stage columns of one row."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("stage"),
                F.lit(position).alias("stage_order"),
                pred.cast("int").alias("pred"),
                valid.alias("valid"),
            )
            for position, (name, (pred, valid)) in enumerate(stages.items())
        ]
    )


def stage_rows(pixels: DataFrame) -> DataFrame:
    """One row per pixel and stage from the ``stages`` array."""
    return pixels.select(*[c for c in pixels.columns if c != "stages"], F.inline("stages"))


# --- region scores and oracles -----------------------------------------------------

def region_to_pixel(
    pixels: DataFrame, region_scores: DataFrame, class_count: int, missing: str = "error"
) -> DataFrame:
    """Look up region scores; uncovered pixels get zeros and ``covered`` = false.

    Uncovered pixels share one region id, so they bypass the join. A covered pixel
    without a score row stops the job, or counts as uncovered when asked.
    """
    zeros = F.array(*[F.lit(0.0)] * class_count)
    uncovered = pixels.where(F.col("region") < 0).select("*", zeros.alias("scores"), F.lit(False).alias("covered"))
    looked_up = pixels.where(F.col("region") >= 0).join(
        region_scores.select("frame_index", "region", F.col("scores").alias("_scores")),
        ["frame_index", "region"],
        "left",
    )
    absent = F.col("_scores").isNull()
    if missing == "error":
        fallback = F.raise_error(F.lit("segmentation references a missing region feature")).cast("array<double>")
        covered = F.lit(True)
    else:
        fallback = zeros
        covered = ~absent
    found = looked_up.withColumn("scores", F.when(absent, fallback).otherwise(F.col("_scores"))).withColumn(
        "covered", covered
    )
    return found.drop("_scores").select(*uncovered.columns).unionByName(uncovered)


def region_counts(pixels: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ("frame_index",)) -> DataFrame:
    """Valid reference pixels per (keys, region, ref) with the region's majority class.

    ``oracle`` is 0 for uncovered pixels. The majority window holds at most one row
    per class.
    """
    counts = pixels.groupBy(*keys, "region", "ref").agg(F.count(F.lit(1)).alias("n"))
    per_region = Window.partitionBy(*keys, "region")
    best = F.max(F.struct("n", (-class_position(F.col("ref"), class_ids)).alias("_rank"), "ref")).over(per_region)
    return (
        counts.withColumn("_best", best)
        .withColumn("region_pixels", F.sum("n").over(per_region))
        .select(
            *keys,
            "region",
            "ref",
            "n",
            "region_pixels",
            F.when(F.col("region") >= 0, F.col("_best.ref")).otherwise(F.lit(0)).alias("oracle"),
            F.when(F.col("region") >= 0, F.col("_best.n")).otherwise(F.lit(0)).alias("majority"),
        )
    )


def region_majority_oracle(
    pixels: DataFrame, valid: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ("frame_index",)
) -> DataFrame:
    """Give every pixel of a region its majority reference class, 0 without labels.

    ``valid`` holds the reference-domain pixels; ``pixels`` is the whole raster.
    """
    majority = (
        valid.where(F.col("region") >= 0)
        .groupBy(*keys, "region", "ref")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys, "region")
        .agg(F.max_by("ref", F.struct("n", -class_position(F.col("ref"), class_ids))).alias("_oracle"))
    )
    covered = pixels.where(F.col("region") >= 0).join(majority, [*keys, "region"], "left")
    covered = covered.withColumn("oracle", F.coalesce("_oracle", F.lit(0))).drop("_oracle")
    bare = pixels.where(F.col("region") < 0).withColumn("oracle", F.lit(0))
    return covered.unionByName(bare)


def region_purity(counts: DataFrame, keys: Sequence[str] = ("frame_index",)) -> DataFrame:
    """Assigned regions, mean region purity and pixel-weighted purity per key."""
    regions = (
        counts.where(F.col("region") >= 0)
        .groupBy(*keys, "region")
        .agg(F.max("majority").alias("majority"), F.sum("n").alias("pixels"))
    )
    return regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assigned_regions"),
        F.avg(ratio(F.col("majority"), F.col("pixels"))).alias("mean_region_purity"),
        ratio(F.sum("majority"), F.sum("pixels")).alias("pixel_weighted_region_purity"),
    )


def _class_rows(groups: DataFrame, class_ids: Sequence[int], name: str = "class_id") -> DataFrame:
    """Every group with every class, from a distinct group table."""
    return groups.select("*", F.explode(F.array(*[F.lit(int(c)) for c in class_ids])).alias(name))


def oracle_per_class(
    counts: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ("frame_index",)
) -> DataFrame:
    """Reference, covered and correct pixels per class with their ratios."""
    sums = counts.groupBy(*keys, F.col("ref").alias("class_id")).agg(
        F.sum("n").alias("reference_pixels"),
        F.sum(F.when(F.col("region") >= 0, F.col("n")).otherwise(0)).alias("covered_pixels"),
        F.sum(F.when(F.col("oracle") == F.col("ref"), F.col("n")).otherwise(0)).alias("correct_pixels"),
    )
    grid = _class_rows(counts.select(*keys).distinct(), class_ids)
    names = ("reference_pixels", "covered_pixels", "correct_pixels")
    dense = grid.join(sums, [*keys, "class_id"], "left").select(
        *keys, "class_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return dense.select(
        "*",
        ratio(F.col("covered_pixels"), F.col("reference_pixels")).alias("coverage"),
        ratio(F.col("correct_pixels"), F.col("reference_pixels")).alias("recall"),
        ratio(F.col("correct_pixels"), F.col("covered_pixels")).alias("covered_accuracy"),
    )


def oracle_by_split(counts: DataFrame, splits: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    """Oracle sums over frames for ``all`` and for each split, with the two loss shares."""
    joined = counts.join(splits.select("frame_index", "split"), "frame_index")
    assigned = (
        joined.where(F.col("region") >= 0)
        .groupBy("split", "frame_index", "region")
        .agg(F.max("oracle").alias("class_id"))
    )
    sums = joined.select(
        "split",
        F.col("ref").alias("class_id"),
        F.col("n").alias("reference_pixels"),
        F.when(F.col("region") >= 0, F.col("n")).otherwise(0).alias("covered_pixels"),
        F.when(F.col("oracle") == F.col("ref"), F.col("n")).otherwise(0).alias("correct_pixels"),
        F.lit(0).cast("bigint").alias("assigned_regions"),
    ).unionByName(
        assigned.select("split", "class_id", F.lit(1).cast("bigint").alias("assigned_regions")),
        allowMissingColumns=True,
    )
    names = ("reference_pixels", "covered_pixels", "correct_pixels", "assigned_regions")
    rolled = sums.groupingSets([["class_id"], ["split", "class_id"]], "split", "class_id").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.grouping("split").alias("_all")
    )
    uncovered = F.col("reference_pixels") - F.col("covered_pixels")
    wrong = F.col("covered_pixels") - F.col("correct_pixels")
    labelled = rolled.withColumn("split", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("split")))
    grid = _class_rows(labelled.select("split").distinct(), class_ids)
    dense = grid.join(labelled.drop("_all"), ["split", "class_id"], "left").select(
        "split", "class_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return dense.select(
        "*",
        uncovered.alias("uncovered_pixels"),
        wrong.alias("covered_wrong_pixels"),
        ratio(F.col("covered_pixels"), F.col("reference_pixels")).alias("coverage"),
        ratio(F.col("correct_pixels"), F.col("covered_pixels")).alias("covered_accuracy"),
        ratio(F.col("correct_pixels"), F.col("reference_pixels")).alias("recall"),
        ratio(uncovered, F.col("reference_pixels")).alias("uncovered_fraction"),
        ratio(wrong, F.col("reference_pixels")).alias("covered_wrong_fraction"),
    )


# --- confusion and metrics ----------------------------------------------------------

def confusion_counts(rows: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Sparse (ref, pred) counts; predictions outside the classes become 0 (unknown)."""
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    known = F.when(is_class(F.col("pred"), class_ids), F.col("pred")).otherwise(F.lit(0))
    return (
        rows.where(is_class(F.col("ref"), class_ids))
        .withColumn("pred", known.cast("int"))
        .groupBy(*keys, "ref", "pred")
        .agg(F.sum(weight).cast("bigint").alias("n"))
    )


def confusion_matrix(rows: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Dense class x (unknown + class) counts."""
    counts = confusion_counts(rows, class_ids, keys)
    groups = counts.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    grid = _class_rows(_class_rows(groups, class_ids, "ref"), [0, *class_ids], "pred")
    return grid.join(counts, [*keys, "ref", "pred"], "left").select(
        *keys, "ref", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_tallies(rows: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with support, prediction and hit sums of every class.

    Works on pixel rows or on counts (column ``n``). All sums come from one
    aggregation, so pixels are combined before they are shuffled.
    """
    n = "n" if "n" in rows.columns else "1"
    classes = ", ".join(str(int(c)) for c in class_ids)
    tests = {"total": "true", "unknown": f"pred not in ({classes})"}
    for c in class_ids:
        tests |= {f"sup_{c}": f"ref = {c}", f"out_{c}": f"pred = {c}", f"hit_{c}": f"ref = {c} and pred = {c}"}
    if "valid" in rows.columns:
        tests["valid_pixels"] = "valid"
    sums = [F.expr(f"cast(coalesce(sum(if({test}, {n}, 0)), 0) as bigint)").alias(name) for name, test in tests.items()]
    return rows.groupBy(*keys).agg(*sums)


def tally_columns(class_ids: Sequence[int]) -> list[str]:
    return ["total", "unknown", *[f"{p}_{c}" for c in class_ids for p in ("sup", "out", "hit")]]


def _mean_of(values: Sequence[str]) -> str:
    known = " + ".join(f"if({v} is null, 0, 1)" for v in values)
    return f"try_divide({' + '.join(f'coalesce({v}, 0D)' for v in values)}, {known})"


def _iou(c: int) -> str:
    return f"try_divide(hit_{c}, sup_{c} + out_{c} - hit_{c})"


def _recall(c: int) -> str:
    return f"try_divide(hit_{c}, sup_{c})"


def _accuracy(class_ids: Sequence[int]) -> str:
    return f"try_divide({' + '.join(f'hit_{c}' for c in class_ids)}, total)"


def scalar_metrics(tallies: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro-IoU over classes with support, coverage."""
    supported = [f"if(sup_{c} > 0, {_iou(c)}, null)" for c in class_ids]
    columns = [
        *keys,
        "total as reference_pixels",
        f"{_accuracy(class_ids)} as pixel_accuracy",
        f"{_mean_of([_recall(c) for c in class_ids])} as balanced_accuracy",
        f"{_mean_of(supported)} as macro_iou",
        "1D - try_divide(unknown, total) as prediction_coverage",
    ]
    if "valid_pixels" in tallies.columns:
        columns.append("try_divide(valid_pixels, total) as stage_valid_coverage")
    return tallies.selectExpr(*columns)


def class_report(
    tallies: DataFrame,
    class_ids: Sequence[int],
    keys: Sequence[str] = (),
    ap: DataFrame | None = None,
    union_rule: bool = False,
) -> DataFrame:
    """Per-class counts, precision, recall, IoU and, when given, AP.

    IoU needs reference support; with ``union_rule`` any non-empty union counts.
    """
    entries = ", ".join(
        f"struct({int(c)} as class_id, sup_{c} as reference_pixels, out_{c} as predicted_pixels, hit_{c} as true_positive)"
        for c in class_ids
    )
    rows = tallies.selectExpr(*keys, f"inline(array({entries}))")
    tp, support, out = F.col("true_positive"), F.col("reference_pixels"), F.col("predicted_pixels")
    iou = ratio(tp, support + out - tp)
    report = rows.select(
        "*",
        (out - tp).alias("false_positive"),
        (support - tp).alias("false_negative"),
        ratio(tp, out).alias("precision"),
        ratio(tp, support).alias("recall"),
        (iou if union_rule else F.when(support > 0, iou)).alias("iou"),
    )
    if ap is None:
        return report
    return report.join(ap.select(*keys, "class_id", "ap"), [*keys, "class_id"], "left")


def metric_report_alpha(
    tallies: DataFrame, class_ids: Sequence[int], known_before_alpha: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Alpha-domain metrics: IoU counts whenever the union is non-empty."""
    weighted = " + ".join(f"sup_{c} * coalesce({_iou(c)}, 0D)" for c in class_ids)
    return tallies.join(known_before_alpha, list(keys), "left").selectExpr(
        *keys,
        "total as reference_pixels",
        "known_before_alpha",
        "try_divide(total, known_before_alpha) as alpha_valid_coverage",
        f"{_accuracy(class_ids)} as pixel_accuracy",
        f"{_mean_of([_recall(c) for c in class_ids])} as balanced_accuracy",
        f"{_mean_of([_iou(c) for c in class_ids])} as macro_iou",
        f"try_divide({weighted}, total) as frequency_weighted_iou",
    )


def average_precision(
    pixels: DataFrame, class_ids: Sequence[int], keys: Sequence[str] = (), scores: str = "scores"
) -> DataFrame:
    """Tie-grouped average precision per class, null without positives.

    Pixels collapse to distinct (class, score) rows first, scores held as FLOAT.
    The running sums then go bucket by bucket of the score's leading bits.
    """
    entries = ", ".join(
        f"struct({int(c)} as class_id, cast(get({scores}, {i}) as float) as score, if(ref = {int(c)}, 1L, 0L) as hit)"
        for i, c in enumerate(class_ids)
    )
    by_score = (
        pixels.selectExpr(*keys, f"inline(array({entries}))")
        .groupBy(*keys, "class_id", "score")
        .agg(F.sum("hit").alias("pos"), F.count(F.lit(1)).alias("seen"))
        .withColumn("_bucket", float_bucket(F.col("score")))
    )
    running = with_running_sums(
        by_score,
        [*keys, "class_id"],
        "_bucket",
        [F.col("score").desc()],
        {"cum_pos": "pos", "cum_seen": "seen"},
        descending=True,
    )
    return running.groupBy(*keys, "class_id").agg(
        ratio(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_seen")), F.sum("pos")).alias("ap"),
        F.sum("pos").alias("positives"),
    )


def macro_ap(ap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ap.groupBy(*keys).agg(F.avg("ap").alias("macro_ap"), F.count("ap").alias("macro_ap_class_count"))


def stage_drops(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Loss and retention of macro-IoU from each stage to the next.

    ``metrics`` has one row per (keys, stage): the window holds the stages only.
    """
    order = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("stage_order")
    before = F.lag("macro_iou").over(order)
    return metrics.select(
        *keys,
        "stage",
        "stage_order",
        "macro_iou",
        (before - F.col("macro_iou")).alias("drop_from_previous"),
        ratio(F.col("macro_iou"), before).alias("retained"),
    )


# --- unknown calibration ---------------------------------------------------------

def calibrate_unknown(
    pixels: DataFrame,
    class_ids: Sequence[int],
    score_grid: Sequence[float],
    margin_grid: Sequence[float],
) -> DataFrame:
    """Training metrics for every (score, margin) threshold pair.

    A pixel counts as known in a cell when its score and margin reach both
    thresholds. So each pixel is reduced to the number of thresholds it reaches in
    either direction, pixels are counted per such corner, and only the corners are
    spread over the cells below them. ``pixels`` has ref, top_class, top_score,
    margin.
    """
    scores, margins = sorted(score_grid), sorted(margin_grid)

    def reached(value: Column, grid: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [(value >= g).cast("int") for g in grid])

    corners = (
        pixels.where(is_class(F.col("ref"), class_ids))
        .groupBy(
            "ref",
            "top_class",
            reached(F.col("top_score"), scores).alias("_s"),
            reached(F.col("margin"), margins).alias("_m"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(scores) - 1)),
            lambda i: F.transform(
                F.sequence(F.lit(0), F.lit(len(margins) - 1)),
                lambda j: F.struct(i.alias("i"), j.alias("j")),
            ),
        )
    )
    score_values = F.array(*[F.lit(float(s)) for s in scores])
    margin_values = F.array(*[F.lit(float(m)) for m in margins])
    spread = corners.select("*", F.inline(cells)).select(
        "ref",
        F.when((F.col("i") < F.col("_s")) & (F.col("j") < F.col("_m")), F.col("top_class"))
        .otherwise(F.lit(0))
        .alias("pred"),
        "n",
        F.get(score_values, F.col("i")).alias("score_threshold"),
        F.get(margin_values, F.col("j")).alias("margin_threshold"),
    )
    keys = ["score_threshold", "margin_threshold"]
    tallies = class_tallies(spread, class_ids, keys)
    return tallies.selectExpr(
        *keys,
        f"{_mean_of([_iou(c) for c in class_ids])} as train_macro_iou",
        f"{_accuracy(class_ids)} as train_pixel_accuracy",
        "1D - try_divide(unknown, total) as known_prediction_coverage",
    )


def best_thresholds(cells: DataFrame) -> DataFrame:
    """Cell with the largest macro-IoU, smaller thresholds on a tie."""
    rank = F.struct(
        F.coalesce("train_macro_iou", F.lit(float("-inf"))), -F.col("score_threshold"), -F.col("margin_threshold")
    )
    return cells.agg(
        F.max_by("score_threshold", rank).alias("score_threshold"),
        F.max_by("margin_threshold", rank).alias("margin_threshold"),
        F.max_by("train_macro_iou", rank).alias("train_macro_iou"),
    )


# --- multi-level evaluation ------------------------------------------------------

def any_level_recoverability(pixels: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    """Per class: reference, covered by any level, right in any level.

    ``levels`` is an array of (pred, valid) structs in the pixel's row.
    """
    covered = F.exists("levels", lambda s: s["valid"])
    right = F.exists("levels", lambda s: s["valid"] & (s["pred"] == F.col("ref")))
    sums = pixels.groupBy(F.col("ref").alias("class_id")).agg(
        F.count(F.lit(1)).alias("reference_pixels"),
        count_when(covered).alias("covered_pixels"),
        count_when(right).alias("correct_pixels"),
    )
    grid = _class_rows(pixels.sparkSession.range(1).select(), class_ids)
    names = ("reference_pixels", "covered_pixels", "correct_pixels")
    dense = grid.join(sums, "class_id", "left").select(
        "class_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return dense.select(
        "*",
        ratio(F.col("covered_pixels"), F.col("reference_pixels")).alias("any_level_coverage"),
        ratio(F.col("correct_pixels"), F.col("reference_pixels")).alias("any_level_recall"),
    )


def area_order_audit(areas: DataFrame, levels: Sequence[str] = ("s", "m", "l")) -> DataFrame:
    """Median area per level and the share of frames in non-decreasing order.

    ``areas`` has (frame_index, level, area_median); a null median fails its frame.
    """
    wide = areas.groupBy("frame_index").agg(
        *[F.max(F.when(F.col("level") == level, F.col("area_median"))).alias(f"m_{level}") for level in levels]
    )
    steps = [F.col(f"m_{a}") <= F.col(f"m_{b}") for a, b in zip(levels, levels[1:])]
    ordered = F.coalesce(reduce(lambda a, b: a & b, steps), F.lit(False))
    return wide.agg(
        *[F.percentile(f"m_{level}", F.lit(0.5)).alias(f"median_{level}") for level in levels],
        count_when(ordered).alias("ordered_frames"),
        F.count(F.lit(1)).alias("frames_tested"),
        ratio(count_when(ordered), F.count(F.lit(1))).alias("ordered_fraction"),
    )


def region_top1_accuracy(
    pixels: DataFrame, region_classes: DataFrame, class_ids: Sequence[int], min_labelled: float = 0.5
) -> DataFrame:
    """Region class against majority label, for regions labelled to the given share."""
    labelled = is_class(F.col("ref"), class_ids)
    counts = (
        pixels.where(F.col("region") >= 0)
        .groupBy("frame_index", "region", F.when(labelled, F.col("ref")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    regions = counts.groupBy("frame_index", "region").agg(
        F.sum("n").alias("pixels"),
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"),
        F.max_by(
            "label", F.when(F.col("label").isNotNull(), F.struct("n", -class_position(F.col("label"), class_ids)))
        ).alias("target"),
    )
    judged = (
        regions.where((F.col("labelled") > 0) & (F.col("labelled") >= min_labelled * F.col("pixels")))
        .join(region_classes.select("frame_index", "region", "region_class"), ["frame_index", "region"])
        .withColumn("right", (F.col("region_class") == F.col("target")).cast("bigint"))
    )
    return judged.agg(
        F.count(F.lit(1)).alias("eligible_regions"),
        ratio(F.sum("right"), F.count(F.lit(1))).alias("region_top1_accuracy"),
        ratio(F.sum(F.col("right") * F.col("labelled")), F.sum("labelled")).alias("pixel_weighted_accuracy"),
    )


# --- images, tables, checks ---------------------------------------------------------

def psnr_depth_l1(pixels: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Mean PSNR over views; depth L1 pooled over pixels with both depths."""
    both = (F.col("gt_depth") > 0) & (F.col("depth") > 0)
    gap = F.when(both, F.abs(F.col("depth") - F.col("gt_depth")))
    error = F.col("color") - F.col("gt_color")
    views = pixels.groupBy(*keys, "frame_index").agg(
        F.avg(error * error).alias("mse"), F.sum(gap).alias("gap"), F.count(gap).alias("depth_pixels")
    )
    return views.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("views"),
        F.avg(-10.0 * F.log10("mse")).alias("psnr"),
        ratio(F.sum("gap"), F.sum("depth_pixels")).alias("depth_l1"),
        F.sum("depth_pixels").alias("depth_pixels"),
    )


def table_diff(
    first: DataFrame, second: DataFrame, row_id: str, exclude_prefixes: Sequence[str] = ()
) -> DataFrame:
    """Largest absolute difference of every shared numeric column.

    ``semantic_`` columns also report minimum, maximum and population deviation of
    both sides. A row found on one side only stops the job.
    """
    numeric = {f.name for f in first.schema.fields if f.dataType.typeName() in (
        "byte", "short", "integer", "long", "float", "double")}
    names = [
        c
        for c in first.columns
        if c in numeric and c in second.columns and c != row_id and not c.startswith(tuple(exclude_prefixes) or "\0")
    ]
    left = first.select(row_id, *[F.col(c).cast("double").alias(f"a_{c}") for c in names])
    right = second.select(F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(f"b_{c}") for c in names])
    joined = left.join(right, left[row_id] == right["_id"], "full_outer")
    unpaired = F.col(row_id).isNull() | F.col("_id").isNull()
    checked = joined.where(
        F.when(unpaired, F.raise_error(F.lit("row sets differ")).cast("boolean")).otherwise(F.lit(True))
    )
    sums = []
    for c in names:
        sums.append(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"d_{c}"))
        if c.startswith("semantic_"):
            for side in ("a", "b"):
                source = F.col(f"{side}_{c}")
                sums += [
                    F.min(source).alias(f"{side}_lo_{c}"),
                    F.max(source).alias(f"{side}_hi_{c}"),
                    F.stddev_pop(source).alias(f"{side}_sd_{c}"),
                ]
    wide = checked.agg(*sums)
    missing = F.lit(None).cast("double")

    def stat(tag: str, c: str) -> Column:
        return F.col(f"{tag}_{c}") if c.startswith("semantic_") else missing

    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("field"),
                        F.col(f"d_{c}").alias("max_abs"),
                        (F.col(f"d_{c}") != 0).alias("changed"),
                        *[
                            stat(f"{side}_{tag}", c).alias(f"{name}_{label}")
                            for side, name in (("a", "first"), ("b", "second"))
                            for tag, label in (("lo", "min"), ("hi", "max"), ("sd", "std"))
                        ],
                    )
                    for c in names
                ]
            )
        )
    )


def preflight_checks(
    expected: DataFrame, archives: DataFrame, reported: DataFrame, facts: DataFrame
) -> DataFrame:
    """Named input checks; ``facts`` has (name, passed, detail, hard) rows.

    Frame sets are compared by anti-joins, and every row carries the overall
    verdict of the hard checks.
    """
    missing = expected.join(archives, "frame_index", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    only_expected = expected.join(reported, "frame_index", "left_anti")
    only_reported = reported.join(expected, "frame_index", "left_anti")
    differing = only_expected.unionByName(only_reported).agg(F.count(F.lit(1)).alias("n"))

    def row(source: DataFrame, name: str, label: str) -> DataFrame:
        return source.select(
            F.lit(name).alias("name"),
            (F.col("n") == 0).alias("passed"),
            F.concat(F.lit(label), F.col("n").cast("string")).alias("detail"),
            F.lit(True).alias("hard"),
        )

    checks = (
        row(missing, "archives_complete", "missing=")
        .unionByName(row(differing, "report_frame_set_exact", "differing="))
        .unionByName(facts.select("name", "passed", "detail", "hard"))
    )
    # One row per named check: the window below holds the check list only.
    verdict = F.min(F.when(F.col("hard"), F.col("passed")).otherwise(F.lit(True))).over(
        Window.partitionBy(F.lit(0))
    )
    return checks.withColumn("all_passed", verdict)


# Pre-registered decision bounds as (gate, metric, comparison, bound).
GATES = [
    ("B", "s0_macro_iou", "ge", 0.50),
    ("C", "s1_over_s0", "ge", 0.70),
    ("D", "s2_over_s1", "ge", 0.95),
    ("D", "top1_agreement", "ge", 0.90),
    ("D", "top1_agreement_margin_0.01", "ge", 0.95),
    ("D", "text_score_mae", "le", 0.02),
    ("E", "s3_over_s2", "ge", 0.90),
    ("E", "coverage_drop", "le", 0.05),
    ("F", "psnr_drop_db", "le", 0.2),
    ("F", "depth_l1_relative_increase", "le", 0.02),
    ("F", "point_count_relative_change", "le", 0.05),
]


def gate_decisions(metrics: DataFrame) -> DataFrame:
    """Compare (metric, value) rows with the fixed bounds; absent metrics stay open."""
    bounds = metrics.sparkSession.createDataFrame(GATES, "gate string, metric string, comparison string, bound double")
    met = F.when(F.col("comparison") == "ge", F.col("value") >= F.col("bound")).otherwise(
        F.col("value") <= F.col("bound")
    )
    return bounds.join(metrics.select("metric", "value"), "metric", "left").select(
        "gate", "metric", "comparison", "bound", "value", met.alias("passed")
    )

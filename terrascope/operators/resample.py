"""Bootstrap intervals over groups of frames.

Pixels never enter: the input is one tally row per (group, stage). Draws are an
integer hash of (replicate, slot), so any executor can recompute them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.single import attach
from terrascope.operators.evaluate import scalar_metrics, tally_columns
from terrascope.operators.ordered import with_positions
from terrascope.session import cut_lineage

_M = 2147483647
METRICS = ("macro_iou", "balanced_accuracy", "pixel_accuracy", "stage_valid_coverage")


def draw(replicate: Column, slot: Column, seed: int, groups: Column) -> Column:
    """Pseudo-random group position from integer arithmetic below 2**62."""
    x = F.pmod(replicate.cast("bigint") * 1000003 + slot.cast("bigint") * 7919 + F.lit(seed * 104729), F.lit(_M))
    h = F.pmod(x * 48271, F.lit(_M))
    h = F.pmod(h * h, F.lit(_M))
    h = F.pmod(h * 69621 + x, F.lit(_M))
    return F.pmod(h, groups)


def frame_blocks(frames: DataFrame, block_size: int) -> DataFrame:
    """Number contiguous blocks of ``block_size`` frames in frame order."""
    bucketed = frames.select("frame_index").distinct().withColumn("_b", F.shiftright("frame_index", 12))
    ordered = with_positions(bucketed, [], "_b", [F.col("frame_index")])
    return ordered.select("frame_index", F.floor(F.col("position") / block_size).cast("bigint").alias("group_id"))


def bootstrap_replicates(
    tallies: DataFrame, class_ids: Sequence[int], replicates: int, seed: int
) -> DataFrame:
    """Pooled metrics of every replicate and stage.

    ``tallies`` has group_id, stage, stage_order, valid_pixels and the tally columns.
    It is written once, so the pixels behind it are read once. Draws are made where the
    replicates lie, without a shuffle; a draw meets its group's tallies, and each task
    adds up its draws per replicate before they meet.
    """
    tallies = cut_lineage(tallies, "tallies")
    names = [*tally_columns(class_ids), "valid_pixels"]
    groups = tallies.select("group_id").distinct().withColumn("_b", F.shiftright("group_id", 12))
    numbered = with_positions(groups, [], "_b", [F.col("group_id")]).select("group_id", "position")
    count = groups.agg(F.count(F.lit(1)).alias("group_count"))
    # As many draws as groups in every replicate: spread from a few rows, they would be
    # estimated small enough for a broadcast.
    picks = (
        attach(tallies.sparkSession.range(replicates).withColumnRenamed("id", "replicate"), count)
        .where("group_count > 0")
        .select("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_count") - 1)).alias("slot"), "group_count")
        .select("replicate", draw(F.col("replicate"), F.col("slot"), seed, F.col("group_count")).alias("position"))
    )
    pooled = (
        picks.hint("merge").join(numbered.join(tallies, "group_id").hint("merge"), "position")
        .groupBy("replicate", "stage", "stage_order")
        .agg(*[F.sum(c).alias(c) for c in names])
    )
    return scalar_metrics(pooled, class_ids, ["replicate", "stage", "stage_order"])


def bootstrap_intervals(replicates: DataFrame) -> DataFrame:
    """Mean and 95% interval per stage metric and per paired stage drop."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    levels = replicates.select("stage", F.inline(entries))
    # A replicate has one row per stage, so this window holds the stages only.
    order = Window.partitionBy("replicate").orderBy("stage_order")
    drops = replicates.select(
        "stage",
        F.lit("macro_iou_drop").alias("metric"),
        (F.lag("macro_iou").over(order) - F.col("macro_iou")).alias("value"),
    ).where(F.col("value").isNotNull())
    return (
        levels.unionByName(drops)
        .groupBy("stage", "metric")
        .agg(
            F.avg("value").alias("bootstrap_mean"),
            F.percentile("value", F.lit(0.025)).alias("ci95_low"),
            F.percentile("value", F.lit(0.975)).alias("ci95_high"),
        )
    )

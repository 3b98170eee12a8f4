"""Class state of map points from ordered observations, as batch queries.

Each recursive rule is rewritten in a form that can be summed, so the observations
of one point need not be read in sequence by one task. The streaming twins keep the
same state per point.

Observations: point_id, ts, seq (unique order within a point), target, conf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.functions.numeric import clip
from terrascope.functions.vectors import softmax
from terrascope.operators.ordered import bucket_width, with_positions, with_previous, with_running_sums
from terrascope.session import cut_lineage

def ordered_observations(observations: DataFrame, class_count: int, bucket_us: int | None = None) -> DataFrame:
    """Valid observations with an order bucket that grows with time, as wide as the table is dense."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    width = bucket_us or bucket_width(observations, us)
    valid = F.col("target").between(1, class_count - 1) & (F.col("conf") > 0)
    return observations.where(valid).select(
        "point_id", "seq", "target", clip(F.col("conf"), 0.0, 1.0).alias("conf"),
        F.floor(us / F.lit(float(width))).cast("bigint").alias("_b"),
        us.alias("_us"),
    )


def _order() -> list[Column]:
    return [F.col("_us"), F.col("seq")]


def observation_ema(observations: DataFrame, class_count: int, alpha: float, scale: float) -> DataFrame:
    """Exponential average per point and class: alpha * scale * sum conf (1-alpha)^(later ones)."""
    placed = with_positions(ordered_observations(observations, class_count), ["point_id"], "_b", _order())
    sizes = placed.groupBy("point_id").agg(F.max("position").alias("_last"))
    decay = F.pow(F.lit(1.0 - alpha), (F.col("_last") - F.col("position")).cast("double"))
    return placed.join(sizes, "point_id").groupBy("point_id", F.col("target").alias("class_id")).agg(
        F.sum(alpha * scale * F.col("conf") * decay).alias("logit")
    )


def observation_cumulative(observations: DataFrame, class_count: int, scale: float) -> DataFrame:
    """Logits from accumulated evidence: scale * evidence / sum of evidence."""
    evidence = (
        ordered_observations(observations, class_count)
        .groupBy("point_id", F.col("target").alias("class_id"))
        .agg(F.sum("conf").alias("evidence"))
    )
    totals = evidence.groupBy("point_id").agg(F.sum("evidence").alias("_all"))
    return evidence.join(totals, "point_id").select(
        "point_id", "class_id", "evidence", (scale * F.col("evidence") / F.greatest("_all", F.lit(1e-6))).alias("logit")
    )


def evidence_history(observations: DataFrame, class_count: int) -> DataFrame:
    """Evidence of the observed class after every observation."""
    rows = ordered_observations(observations, class_count)
    return with_running_sums(rows, ["point_id", "target"], "_b", _order(), {"evidence": "conf"}).select(
        "point_id", "seq", "target", "evidence"
    )


def observation_switch(
    observations: DataFrame, class_count: int, alpha: float, scale: float, switch_support: float
) -> DataFrame:
    """Hysteresis class state per point: label, strength, pending label and support.

    Observations are cut into runs of one target. A pending label can only be the
    target of the running run, so each run starts with no pending support and acts on
    the label alone: a run whose confidence reaches the bound sets the label to its
    target, any other run leaves it. The first run sets the label of an empty point.
    The label after a point is thus the target of its last deciding run, and strength
    follows from the observations since the last change of label. Every step is a
    bucketed window or a sum. Each pass reads its input twice, so passes are written
    in between. A first observation must lift the strength over 1e-6.
    """
    key = ["point_id"]
    valid = ordered_observations(observations, class_count)
    rows = cut_lineage(with_previous(valid, key, "_b", _order(), "target", "_before"), "before")
    starts = rows.withColumn(
        "_start", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("target")), 1).otherwise(0).cast("bigint")
    )
    numbered = with_running_sums(starts, key, "_b", _order(), {"run": "_start"}).drop("_before", "_start")
    numbered = cut_lineage(numbered, "runs")
    summed = with_running_sums(numbered, ["point_id", "run"], "_b", _order(), {"run_conf": "conf"})
    summed = cut_lineage(summed, "run-sums")

    runs = summed.groupBy("point_id", "run", "target").agg(
        F.sum("conf").alias("total"), F.min("_b").alias("_rb"), F.max(F.struct("_us", "seq")).alias("_end")
    )
    deciding = runs.where((F.col("run") == 1) | (F.col("total") >= switch_support))
    changes = with_previous(deciding, key, "_rb", [F.col("run")], "target", "_label").withColumn(
        "_changes", F.col("_label").isNull() | (F.col("_label") != F.col("target"))
    )
    points = cut_lineage(
        changes.groupBy("point_id").agg(
            F.max_by("target", "run").alias("label"), F.max(F.when(F.col("_changes"), F.col("run"))).alias("since_run")
        ),
        "points",
    )
    last_run = runs.groupBy("point_id").agg(
        F.max_by(F.struct("run", "target", "total"), "run").alias("tail")
    )

    # Observations that update the strength: since the change, of the label's class.
    since = summed.join(points, "point_id").where((F.col("run") >= F.col("since_run")) & (F.col("target") == F.col("label")))
    first_run = F.col("since_run") == 1
    before_switch = (F.col("run") == F.col("since_run")) & ~first_run & (F.col("run_conf") < switch_support)
    at_switch = (
        (F.col("run") == F.col("since_run")) & ~first_run
        & (F.col("run_conf") >= switch_support) & (F.col("run_conf") - F.col("conf") < switch_support)
    )
    used = since.where(~before_switch).withColumn("_reset", at_switch)
    placed = with_positions(used.drop("since_run", "label"), key, "_b", _order())
    sizes = placed.groupBy("point_id").agg(F.max("position").alias("_last"))
    decay = F.pow(F.lit(1.0 - alpha), (F.col("_last") - F.col("position")).cast("double"))
    gain = F.when(F.col("_reset"), F.lit(1.0)).otherwise(F.lit(alpha))
    strength = placed.join(sizes, "point_id").groupBy("point_id").agg(
        F.sum(gain * scale * F.col("conf") * decay).alias("strength")
    )
    pending = F.col("tail.target") != F.col("label")
    return (
        points.join(strength, "point_id")
        .join(last_run, "point_id")
        .select(
            "point_id", "label", "strength",
            F.when(pending, F.col("tail.target")).otherwise(F.lit(0)).alias("pending_label"),
            F.when(pending, F.col("tail.total")).otherwise(F.lit(0.0)).alias("pending_support"),
        )
    )


def support_max(observations: DataFrame, class_count: int) -> DataFrame:
    return ordered_observations(observations, class_count).groupBy("point_id").agg(F.max("conf").alias("support"))


def support_sum(observations: DataFrame, class_count: int) -> DataFrame:
    """Accumulated confidence of labelled observations; others add nothing."""
    labelled = F.col("target").between(1, class_count - 1)
    return observations.groupBy("point_id").agg(
        F.sum(F.when(labelled, F.col("conf")).otherwise(F.lit(0.0))).alias("support"),
        F.count(F.when(labelled, 1)).alias("observations"),
    )


def export_decision(points: DataFrame, min_support: float = 0.5, min_confidence: float = 0.35) -> DataFrame:
    """Exported label and confidence of each point.

    points(point_id, logits[class 0..], support). The confidence is scaled by the
    support held in [0, 1].
    """
    from terrascope.functions.vectors import top_first

    scored = points.withColumn("_p", softmax(F.col("logits"))).withColumn("_top", F.array_max("_p"))
    trusted = (F.col("support") >= min_support) & (F.col("_top") >= min_confidence)
    return scored.select(
        "point_id",
        F.when(trusted, top_first(F.col("_p"))).otherwise(F.lit(0)).alias("label"),
        (F.col("_top") * clip(F.col("support"), 0.0, 1.0)).alias("confidence"),
    )


def logit_arrays(logits: DataFrame, class_count: int) -> DataFrame:
    """One dense logit array per point; classes never observed read 0."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("logit"))), F.lit(0.0)).alias(f"_c{c}")
        for c in range(class_count)
    ]
    return logits.groupBy("point_id").agg(*columns).select(
        "point_id", F.array(*[F.col(f"_c{c}") for c in range(class_count)]).alias("logits")
    )


def incremental_append(current: DataFrame, fresh: DataFrame, scale: float) -> DataFrame:
    """Map with new points appended: their evidence is initial strength / scale, no pending label."""
    added = fresh.select(
        "point_id", "class_id", (F.col("strength") / scale).alias("evidence"), F.lit(0).alias("pending_label"),
        F.lit(0.0).alias("pending_support"), F.lit(True).alias("is_new"),
    )
    return current.select(
        "point_id", "class_id", "evidence", "pending_label", "pending_support", F.lit(False).alias("is_new")
    ).unionByName(added)


def replay_window(keyframes: DataFrame, window: int) -> DataFrame:
    """The last ``window`` keyframes; all of them when the window is not positive.

    Top-k: each task keeps its own last frames before they meet.
    """
    if window <= 0:
        return keyframes.select("frame_index").distinct()
    return keyframes.select("frame_index").distinct().orderBy(F.col("frame_index").desc()).limit(window)

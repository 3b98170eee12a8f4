"""Region vectors: projection, relevancy, preservation, covariance and codebooks.

Prompts, bases and codebooks are small model inputs. They are read with an explicit
bound and shipped as matrices; region vectors stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.functions.numeric import clip, finite, ratio, sigmoid
from terrascope.functions.single import attach
from terrascope.functions.vectors import (
    affine_reconstruct,
    l2_normalize,
    norm2,
    row_dot,
    runner_up,
    times_matrix,
    top_last,
    weighted_mean_abs_gap,
)
from terrascope.operators.ordered import exact_percentiles, float_bucket, with_positions, with_running_sums
from terrascope.session import cut_lineage

MAX_PROMPTS = 4096
MAX_DIMENSION = 1024
FINE = 1 << 17  # buckets between a power of two and the next, also for values that crowd below 1


def fine_bucket() -> Column:
    return float_bucket(F.col("_value"), FINE)


# --- prompts ------------------------------------------------------------------------

@dataclass(frozen=True)
class PromptBank:
    """Unit prompt vectors, ordered by class and query; negatives apart."""

    class_ids: list[int]
    query_ids: list[int]
    query_class: list[int]
    positives: np.ndarray
    negatives: np.ndarray


def bounded_rows(df: DataFrame, limit: int) -> list:
    """Rows of a table that must be small; more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a table that must stay small")
    return rows


def load_prompts(prompts: DataFrame, limit: int = MAX_PROMPTS) -> PromptBank:
    """prompts(class_id, query_id, feature); class -1 marks negatives."""
    rows = sorted(
        bounded_rows(prompts.select("class_id", "query_id", "feature"), limit),
        key=lambda r: (r["class_id"], r["query_id"]),
    )
    positive = [r for r in rows if r["class_id"] >= 0]
    negative = [r for r in rows if r["class_id"] < 0]
    if not positive or not negative:
        raise ValueError("positive and negative prompts are required")

    def unit(selected: list) -> np.ndarray:
        matrix = np.asarray([r["feature"] for r in selected], dtype=np.float64)
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    return PromptBank(
        class_ids=sorted({int(r["class_id"]) for r in positive}),
        query_ids=[int(r["query_id"]) for r in positive],
        query_class=[int(r["class_id"]) for r in positive],
        positives=unit(positive),
        negatives=unit(negative),
    )


# --- basis ---------------------------------------------------------------------------

def pca_project(items: DataFrame, mean: np.ndarray, basis: np.ndarray, feature: str = "feature") -> DataFrame:
    """basis_dot = x B and mean_dot = x . mean for every vector, in one product."""
    both = np.hstack([basis, np.asarray(mean, dtype=np.float64).reshape(-1, 1)])
    k = basis.shape[1]
    dotted = items.withColumn("_d", times_matrix(F.col(feature), both))
    return dotted.select(
        *items.columns, F.slice("_d", 1, k).alias("basis_dot"), F.get("_d", F.lit(k)).alias("mean_dot")
    )


def latents(items: DataFrame, mean: np.ndarray, basis: np.ndarray, feature: str = "feature") -> DataFrame:
    """Compressed coordinates (x - mean) B."""
    shift = [float(v) for v in (np.asarray(mean).reshape(1, -1) @ basis).ravel()]
    raw = times_matrix(F.col(feature), basis)
    return items.withColumn("_raw", raw).withColumn(
        "latent", F.zip_with("_raw", F.array(*[F.lit(v) for v in shift]), lambda a, b: a - b)
    ).drop("_raw")


def pca_reconstruct(items: DataFrame, mean: np.ndarray, basis: np.ndarray, feature: str = "feature") -> DataFrame:
    return items.withColumn("reconstructed", affine_reconstruct(F.col(feature), mean, basis))


def latent_cosine(
    items: DataFrame, mean: np.ndarray, basis: np.ndarray, queries: np.ndarray, latent: str = "latent"
) -> DataFrame:
    """Cosine of each query with the vector a latent stands for, without rebuilding it.

    One product gives z . basis_dot for all queries and z . basis_mean.
    """
    mean = np.asarray(mean, dtype=np.float64).ravel()
    matrix = np.hstack([(queries @ basis).T, (mean @ basis).reshape(-1, 1)])
    count = queries.shape[0]
    offsets = F.array(*[F.lit(float(v)) for v in queries @ mean])
    dotted = items.withColumn("_d", times_matrix(F.col(latent), matrix))
    square = F.lit(float(mean @ mean)) + 2.0 * F.get("_d", F.lit(count)) + norm2(F.col(latent))
    scale = F.sqrt(F.greatest(square, F.lit(1e-12)))
    return (
        dotted.withColumn("_s", scale)
        .withColumn("cosines", F.zip_with(F.slice("_d", 1, count), offsets, lambda a, b: (a + b) / F.col("_s")))
        .drop("_d", "_s")
    )


# --- relevancy ----------------------------------------------------------------------------

def relevancy(items: DataFrame, bank: PromptBank, feature: str = "feature", output: str = "relevancy") -> DataFrame:
    """Per positive prompt: smallest probability against all negatives.

    The logistic function is monotone, so the largest negative similarity decides.
    """
    count = len(bank.query_ids)
    matrix = np.vstack([bank.positives, bank.negatives]).T
    dotted = items.withColumn("_d", times_matrix(F.col(feature), matrix)).withColumn(
        "_n", F.array_max(F.slice("_d", count + 1, len(bank.negatives)))
    )
    return dotted.withColumn(
        output, F.transform(F.slice("_d", 1, count), lambda p: sigmoid(10.0 * (p - F.col("_n"))))
    ).drop("_d", "_n")


def prompt_aggregate(
    items: DataFrame, bank: PromptBank, how: str = "max", source: str = "relevancy", output: str = "scores"
) -> DataFrame:
    """Class scores in class order: maximum or mean over the prompts of the class."""
    per_class = []
    for c in bank.class_ids:
        parts = [F.get(F.col(source), F.lit(i)) for i, owner in enumerate(bank.query_class) if owner == c]
        if how == "max":
            per_class.append(F.greatest(*parts) if len(parts) > 1 else parts[0])
        elif how == "mean":
            per_class.append(sum(parts[1:], parts[0]) / len(parts))
        else:
            raise ValueError(f"unknown aggregation: {how}")
    return items.withColumn(output, F.array(*per_class))


def class_scores(items: DataFrame, bank: PromptBank, how: str = "max", feature: str = "feature", output: str = "scores") -> DataFrame:
    return prompt_aggregate(relevancy(items, bank, feature, "_rel"), bank, how, "_rel", output).drop("_rel")


def query_raster_scores(rasters: DataFrame, query_classes: dict[int, list[int]], how: str = "max") -> DataFrame:
    """Class scores per pixel from one raster row per query; scores are 16-bit.

    One aggregation per pixel; each class reads its own queries.
    """
    score = F.col("score_u16") / 65535.0
    reduce_by = {"max": F.max, "mean": F.avg}[how]
    columns = [
        reduce_by(F.when(F.col("query_id").isin(queries), score)).alias(f"_c{c}")
        for c, queries in query_classes.items()
    ]
    wide = rasters.groupBy("frame_index", "u", "v").agg(*columns)
    return wide.select("frame_index", "u", "v", F.array(*[F.col(f"_c{c}") for c in query_classes]).alias("scores"))


# --- decisions --------------------------------------------------------------------------------

def top1_margin(items: DataFrame, scores: str = "scores") -> DataFrame:
    """Top position (highest on a tie), its score and the gap to the runner-up."""
    best = F.array_max(scores)
    return items.select(
        "*",
        top_last(F.col(scores)).alias("top"),
        best.alias("top_score"),
        (best - runner_up(F.col(scores))).alias("margin"),
    )


def predict_unknown(
    items: DataFrame, class_ids: Sequence[int], score_threshold: float, margin_threshold: float, scores: str = "scores"
) -> DataFrame:
    """Top class, 0 when its score or margin stays below a threshold; needs two classes."""
    if len(class_ids) < 2:
        raise ValueError("at least two classes are needed for a margin")
    decided = top1_margin(items, scores)
    sure = (F.col("top_score") >= score_threshold) & (F.col("margin") >= margin_threshold)
    ids = F.array(*[F.lit(int(c)) for c in class_ids])
    return decided.withColumn("pred", F.when(sure, F.get(ids, F.col("top"))).otherwise(F.lit(0)))


def predict_argmax(items: DataFrame, class_ids: Sequence[int], valid: Column, scores: str = "scores") -> DataFrame:
    """Class of the largest score on valid rows (lowest class on a tie), 0 elsewhere."""
    from terrascope.functions.vectors import top_first

    ids = F.array(*[F.lit(int(c)) for c in class_ids])
    return items.withColumn("pred", F.when(valid, F.get(ids, top_first(F.col(scores)))).otherwise(F.lit(0)))


def assign_query_class(items: DataFrame, labels: Sequence[int], cosines: str = "cosines") -> DataFrame:
    """Best query of each map point with similarity and margin."""
    ids = F.array(*[F.lit(int(c)) for c in labels])
    decided = top1_margin(items, cosines)
    return decided.select(
        *[c for c in items.columns if c != cosines],
        F.get(ids, F.col("top")).alias("query_id"), F.col("top_score").alias("similarity"), "margin",
    )


def query_class_counts(assigned: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Points per query, zero rows included."""
    listed = assigned.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(c)) for c in labels])).alias("query_id")
    )
    counts = assigned.groupBy("query_id").agg(F.count(F.lit(1)).alias("points"))
    return listed.join(counts, "query_id", "left").select("query_id", F.coalesce("points", F.lit(0)).alias("points"))


# --- compression quality -----------------------------------------------------------------------

def query_preservation(items: DataFrame, full: str = "full", compact: str = "compact") -> DataFrame:
    """Agreement of the top query before and after compression, and score errors."""
    marked = items.select(
        top_last(F.col(full)).alias("_f"),
        top_last(F.col(compact)).alias("_c"),
        (F.array_max(full) - runner_up(F.col(full))).alias("_m"),
        F.zip_with(full, compact, lambda a, b: F.abs(a - b)).alias("_e"),
    )
    same = (F.col("_f") == F.col("_c")).cast("double")
    error_sum = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x)
    return marked.agg(
        F.count(F.lit(1)).alias("regions"),
        F.avg(same).alias("top1_agreement"),
        F.avg(F.when(F.col("_m") >= 0.01, same)).alias("agreement_margin_01"),
        F.avg(F.when(F.col("_m") >= 0.02, same)).alias("agreement_margin_02"),
        F.avg("_m").alias("full_margin_mean"),
        ratio(F.sum(error_sum), F.sum(F.size("_e"))).alias("score_mae"),
        F.max(F.array_max("_e")).alias("score_max_abs"),
    )


def top1_counts(items: DataFrame, labels: Sequence[int], scores: str) -> DataFrame:
    ids = F.array(*[F.lit(int(c)) for c in labels])
    chosen = items.select(F.get(ids, top_last(F.col(scores))).alias("query_id"))
    return query_class_counts(chosen, labels)


def paired_scores(items: DataFrame, query_ids: Sequence[int], keys: Sequence[str], full: str = "full", compact: str = "compact") -> DataFrame:
    """One row per item and query with both scores."""
    pairs = F.arrays_zip(F.array(*[F.lit(int(q)) for q in query_ids]).alias("query_id"), F.col(full), F.col(compact))
    return items.select(*keys, F.inline(pairs)).toDF(*keys, "query_id", "full", "compact")


def relevancy_audit(pairs: DataFrame) -> DataFrame:
    """Error, correlation and level of compressed relevancy, per query and overall (query -1)."""
    gap = F.abs(F.col("full") - F.col("compact"))
    tagged = pairs.withColumn("gap", gap)
    spread = F.stddev_pop("full") * F.stddev_pop("compact")
    per_query = tagged.groupBy("query_id").agg(
        F.avg("gap").alias("mae"),
        F.max("gap").alias("max_error"),
        F.when(spread > 1e-12, F.corr("full", "compact")).alias("pearson"),
        F.avg("full").alias("relevancy_mean"),
    )
    level = exact_percentiles(tagged, ["query_id"], "full", {"relevancy_p95": 0.95}, fine_bucket())
    overall = tagged.agg(F.avg("gap").alias("mae"), F.max("gap").alias("max_error"))
    tail = exact_percentiles(tagged, [], "gap", {"p95_error": 0.95}, fine_bucket())
    whole = attach(overall, tail).withColumn("query_id", F.lit(-1).cast("bigint"))
    return per_query.join(level, "query_id").unionByName(whole, allowMissingColumns=True)


def _top_members(pairs: DataFrame, sizes: DataFrame, keys: list[str], column: str, flag: str) -> DataFrame:
    """Rows among the ``_size`` largest of their key; ties go to the lower region.

    Equal scores collapse to levels whose running counts show the level that the size
    cuts. Higher levels enter whole; only that level's rows are ordered, in buckets.
    """
    levels = (
        pairs.groupBy(*keys, F.col(column).alias("_level"))
        .agg(F.count(F.lit(1)).alias("_seen"))
        .withColumn("_bucket", F.floor(F.col("_level") * FINE).cast("bigint"))
    )
    running = with_running_sums(levels, keys, "_bucket", [F.col("_level").desc()], {"_upto": "_seen"}, descending=True)
    above = F.col("_upto") - F.col("_seen")
    cut = (
        running.join(sizes, keys)
        .where((above < F.col("_size")) & (F.col("_size") <= F.col("_upto")))
        .select(*keys, "_level", (F.col("_size") - above).alias("_take"))
    )
    faced = pairs.select(*keys, "region", F.col(column).alias("_score")).join(cut, keys)
    whole = faced.where(F.col("_score") > F.col("_level")).select(*keys, "region")
    tied = faced.where(F.col("_score") == F.col("_level")).withColumn("_bucket", F.shiftright("region", 12))
    taken = with_positions(tied, keys, "_bucket", [F.col("region")]).where(F.col("position") < F.col("_take"))
    return whole.unionByName(taken.select(*keys, "region")).withColumn("side", F.lit(flag))


def topset_jaccard(pairs: DataFrame, share: float = 0.1) -> DataFrame:
    """Mean over frames of the overlap of the two top sets, per query.

    pairs(frame_index, region, query_id, full, compact), written once because both
    sets read it. No frame is ordered by one task.
    """
    frame = ["frame_index", "query_id"]
    pairs = cut_lineage(pairs.select(*frame, "region", "full", "compact"), "pairs")
    sizes = pairs.groupBy(*frame).agg(F.greatest(F.lit(1), F.ceil(share * F.count(F.lit(1)))).alias("_size"))
    chosen = _top_members(pairs, sizes, frame, "full", "full").unionByName(
        _top_members(pairs, sizes, frame, "compact", "compact")
    )
    rows = chosen.groupBy(*frame, "region").agg(F.count(F.lit(1)).alias("sides"))
    frames = rows.groupBy(*frame).agg(
        ratio(F.count(F.when(F.col("sides") == 2, 1)), F.count(F.lit(1))).alias("jaccard")
    )
    return frames.groupBy("query_id").agg(F.avg("jaccard").alias("frame_mean_jaccard"), F.count(F.lit(1)).alias("frames"))


# --- scores of masks and regions ------------------------------------------------------------------

def region_confidence(regions: DataFrame) -> DataFrame:
    return regions.withColumn("confidence", F.sqrt(clip(F.col("predicted_iou") * F.col("stability"), 0.0, 1.0)))


def mask_score(regions: DataFrame) -> DataFrame:
    return regions.withColumn("score", F.col("predicted_iou") * F.col("stability"))


def feature_qc(items: DataFrame, feature: str = "feature") -> DataFrame:
    """Row count, dimensions, norm range and finiteness."""
    sane = F.forall(feature, lambda x: finite(x))
    length = F.sqrt(norm2(F.col(feature)))
    return items.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(feature)).alias("dimension_min"),
        F.max(F.size(feature)).alias("dimension_max"),
        F.min(length).alias("norm_min"),
        F.max(length).alias("norm_max"),
        F.bool_and(sane).alias("all_finite"),
    )


# --- rendered language pixels ------------------------------------------------------------------------

def supervised_pixels(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """Labelled static pixels with their region target; ``visible`` tells the rendered ones.

    pixels(frame_index, u, v, region_id, alpha, static, latent);
    targets(frame_index, region_id, basis_dot, mean_dot, confidence).
    """
    wanted = pixels.where((F.col("region_id") > 0) & F.col("static"))
    return wanted.join(targets, ["frame_index", "region_id"]).withColumn("visible", F.col("alpha") > 0.05)


def weighted_language_cosine(supervised: DataFrame, splits: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Confidence-weighted mean cosine per split with pixel and view counts."""
    mean = np.asarray(mean, dtype=np.float64).ravel()
    shift = times_matrix(F.col("latent"), (mean @ basis).reshape(-1, 1))
    square = F.lit(float(mean @ mean)) + 2.0 * F.get("_shift", F.lit(0)) + norm2(F.col("latent"))
    cosine = (F.col("mean_dot") + F.col("_dot")) / F.sqrt(F.greatest(square, F.lit(1e-12)))
    weight = F.when(F.col("visible"), F.col("confidence"))
    return (
        supervised.join(splits.select("frame_index", "split"), "frame_index")
        .withColumn("_shift", shift)
        .withColumn("_dot", row_dot(F.col("latent"), F.col("basis_dot")))
        .withColumn("_cos", clip(cosine, -1.0, 1.0))
        .groupBy("split")
        .agg(
            ratio(F.sum(weight * F.col("_cos")), F.sum(weight)).alias("language_cosine"),
            F.count(F.when(F.col("visible"), 1)).alias("valid_pixels"),
            F.count(F.lit(1)).alias("target_pixels"),
            F.count_distinct("frame_index").alias("target_views"),
        )
    )


def coefficient_l1(supervised: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Confidence-weighted mean absolute gap of latents to target coefficients, per frame."""
    shift = [float(v) for v in (np.asarray(mean).reshape(1, -1) @ basis).ravel()]
    target = F.zip_with("basis_dot", F.array(*[F.lit(v) for v in shift]), lambda a, b: a - b)
    return (
        supervised.where("visible")
        .withColumn("_gap", weighted_mean_abs_gap(F.col("latent"), target))
        .groupBy("frame_index")
        .agg(ratio(F.sum(F.col("_gap") * F.col("confidence")), F.sum("confidence")).alias("coefficient_l1"))
    )


# --- covariance -----------------------------------------------------------------------------------

def weighted_moments(
    items: DataFrame, weight: Column | None = None, feature: str = "feature", combine_tasks: int = 16
) -> DataFrame:
    """(i, j, value) sums: i = j = -1 weight, j = -1 weighted sum, else weighted product.

    Every task folds its vectors into one block; a second, narrower round folds the
    blocks. Only then are entries laid out and summed, so the shuffle carries a few
    blocks of d x d values instead of d x d values per vector.
    """
    prepared = items.select(
        F.transform(feature, lambda x: x.cast("double")).alias("x"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
    )
    block = pa.schema([("block", pa.list_(pa.float64()))])

    def widen(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((x.shape[0], 1)), x])

    def emit(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], schema=block)

    def fold_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = widen(flat.reshape(batch.num_rows, -1))
            part = x.T @ (x * batch.column(1).to_numpy(zero_copy_only=False)[:, None])
            total = part if total is None else total + part
        yield from emit(total)

    def fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                part = row.values.to_numpy()
                total = part.copy() if total is None else total + part
        yield from emit(total)

    folded = prepared.mapInArrow(fold_vectors, "block array<double>")
    narrow = folded.repartition(combine_tasks).mapInArrow(fold_blocks, "block array<double>")
    side = F.sqrt(F.size("block")).cast("int")
    return (
        narrow.select(side.alias("_side"), F.posexplode("block").alias("_p", "value"))
        .select((F.floor(F.col("_p") / F.col("_side")) - 1).alias("i"), (F.col("_p") % F.col("_side") - 1).alias("j"), "value")
        .groupBy("i", "j")
        .agg(F.sum("value").alias("value"))
    )


def _moment_parts(moments: DataFrame) -> DataFrame:
    whole = moments.where((F.col("i") == -1) & (F.col("j") == -1)).select(F.col("value").alias("weight_sum"))
    sums = moments.where((F.col("i") >= 0) & (F.col("j") == -1)).select("i", (F.col("value")).alias("s"))
    products = moments.where((F.col("i") >= 0) & (F.col("j") >= 0)).select("i", "j", F.col("value").alias("p"))
    paired = products.join(sums.withColumnRenamed("s", "si"), "i").join(
        sums.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j"
    )
    return attach(paired, whole)


def covariance(moments: DataFrame) -> DataFrame:
    """(i, j, cov, mean_i, mean_j) with divisor max(weight - 1, 1)."""
    w = F.col("weight_sum")
    centred = F.col("p") - F.col("si") * F.col("sj") / w
    return _moment_parts(moments).select(
        "i", "j", (centred / F.greatest(w - 1.0, F.lit(1.0))).alias("cov"), (F.col("si") / w).alias("mean_i"), (F.col("sj") / w).alias("mean_j")
    )


def two_population_weights(scene: DataFrame, text: DataFrame, mass_ratio: float) -> DataFrame:
    """Scene vectors weigh 1; text vectors share ``mass_ratio`` times the scene weight."""
    counted = attach(text.select("feature"), scene.agg(F.count(F.lit(1)).alias("_a")))
    weighted = attach(counted, text.agg(F.count(F.lit(1)).alias("_b"))).select(
        "feature", (mass_ratio * F.col("_a") / F.greatest("_b", F.lit(1))).alias("weight")
    )
    return scene.select("feature", F.lit(1.0).alias("weight")).unionByName(weighted)


@dataclass(frozen=True)
class Basis:
    mean: np.ndarray
    matrix: np.ndarray
    eigenvalues: np.ndarray
    explained: float


def fit_basis(cov: DataFrame, dimension: int) -> Basis:
    """Leading eigenvectors of a covariance table; at most MAX_DIMENSION squared entries."""
    rows = bounded_rows(cov.select("i", "j", "cov", "mean_i"), MAX_DIMENSION * MAX_DIMENSION)
    size = max(r["i"] for r in rows) + 1
    matrix, mean = np.zeros((size, size)), np.zeros(size)
    for r in rows:
        matrix[r["i"], r["j"]] = r["cov"]
        mean[r["i"]] = r["mean_i"]
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2.0)
    values, vectors = values[::-1], vectors[:, ::-1]
    positive = np.clip(values, 0.0, None)
    return Basis(mean, vectors[:, :dimension].copy(), values, float(positive[:dimension].sum() / positive.sum()))


# --- codebooks --------------------------------------------------------------------------------------

def vector_means(items: DataFrame, key: str, feature: str = "feature") -> DataFrame:
    """Mean vector per key; the key set is small (cluster ids).

    Tasks fold their rows into one sum per key first, so a popular key costs one row
    per task in the shuffle.
    """
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k in np.unique(keys):
                chosen = x[keys == k]
                counts[int(k)] = counts.get(int(k), 0) + chosen.shape[0]
                sums[int(k)] = sums.get(int(k), 0.0) + chosen.sum(axis=0)
        ids = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([counts[k] for k in ids], pa.int64()),
                pa.array([sums[k] for k in ids], pa.list_(pa.float64())),
            ],
            schema=out,
        )

    partial = items.select(F.col(key).cast("bigint"), F.transform(feature, lambda x: x.cast("double"))).mapInArrow(
        fold, "key bigint, n bigint, total array<double>"
    )
    totals = partial.groupBy("key").agg(F.sum("n").alias("n"))
    means = (
        partial.select("key", F.posexplode("total").alias("i", "value"))
        .groupBy("key", "i")
        .agg(F.sum("value").alias("value"))
    )
    return means.join(totals, "key").select("key", "i", "n", (F.col("value") / F.col("n")).alias("value"))


def _seed_order(column: Column, seed: int) -> Column:
    x = F.pmod(column.cast("bigint") * 48271 + F.lit(seed * 7919 + 1), F.lit(2147483647))
    return F.pmod(x * x + 12345, F.lit(2147483647))


def assign_center(items: DataFrame, centers: np.ndarray, feature: str = "feature") -> DataFrame:
    """Closest centre by cosine (lowest index on a tie) and its similarity."""
    from terrascope.functions.vectors import top_first

    return (
        items.withColumn("_c", times_matrix(F.col(feature), centers.T))
        .withColumn("center", top_first(F.col("_c")))
        .withColumn("similarity", F.array_max("_c"))
        .drop("_c")
    )


def codebook_kmeans(items: DataFrame, item_id: str, count: int, iterations: int, seed: int, feature: str = "feature") -> np.ndarray:
    """Cosine k-means: seeded start, argmax assignment, renormalised means.

    Only the centres return to the driver (count x dimension). Vectors are written
    once to the shared folder, so an iteration re-reads files, not the whole lineage.
    Empty clusters are reseeded from the seeded order.
    """
    if count > MAX_PROMPTS:
        raise ValueError(f"at most {MAX_PROMPTS} centres")
    unit = cut_lineage(items.select(F.col(item_id).alias("id"), l2_normalize(F.col(feature)).alias("feature")), "kmeans")
    order = unit.orderBy(_seed_order(F.col("id"), seed), "id")
    # A top-k: each task keeps its best rows, 2 x count rows reach the driver.
    start = np.asarray([r["feature"] for r in order.limit(2 * count).collect()], dtype=np.float64)
    count = min(count, start.shape[0])
    spare = start[count:] if start.shape[0] > count else start
    centers = start[:count].copy()
    for _ in range(iterations):
        means = bounded_rows(vector_means(assign_center(unit, centers), "center"), count * centers.shape[1])
        fresh = np.zeros_like(centers)
        seen = np.zeros(count, dtype=bool)
        for r in means:
            fresh[r["key"], r["i"]] = r["value"]
            seen[r["key"]] = True
        for position, empty in enumerate(np.flatnonzero(~seen)):
            fresh[empty] = spare[position % spare.shape[0]]
        centers = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
    return centers


def codebook_quality(items: DataFrame, centers: np.ndarray, feature: str = "feature") -> DataFrame:
    """Mean and 5th percentile of the similarity to the closest centre."""
    assigned = assign_center(items.withColumn("_u", l2_normalize(F.col(feature))), centers, "_u")
    plain = assigned.agg(F.count(F.lit(1)).alias("regions"), F.avg("similarity").alias("top1_cosine_mean"))
    low = exact_percentiles(assigned, [], "similarity", {"top1_cosine_p05": 0.05}, fine_bucket())
    return attach(plain, low)


def topk_reconstruction_cosine(items: DataFrame, centers: np.ndarray, topk: int = 4, ridge: float = 1e-4, feature: str = "feature") -> DataFrame:
    """Cosine of each vector with its ridge least-squares mix of the ``topk`` closest centres."""
    k = min(topk, centers.shape[0])

    @F.arrow_udf("double")
    def solve(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        nearest = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :k]
        chosen = centers[nearest]
        gram = chosen @ chosen.transpose(0, 2, 1) + ridge * np.eye(k)
        right = np.einsum("nkd,nd->nk", chosen, x)
        mix = np.linalg.solve(gram, right[..., None])[..., 0]
        rebuilt = np.einsum("nk,nkd->nd", mix, chosen)
        rebuilt /= np.maximum(np.linalg.norm(rebuilt, axis=1, keepdims=True), 1e-12)
        return pa.array(np.einsum("nd,nd->n", x, rebuilt))

    return items.withColumn("topk_cosine", solve(l2_normalize(F.col(feature))))


def codebook_topk_ls(items: DataFrame, centers: np.ndarray, topk: int = 4) -> DataFrame:
    scored = topk_reconstruction_cosine(items, centers, topk)
    plain = scored.agg(F.count(F.lit(1)).alias("regions"), F.avg("topk_cosine").alias("topk_cosine_mean"))
    low = exact_percentiles(scored, [], "topk_cosine", {"topk_cosine_p05": 0.05}, fine_bucket())
    return attach(plain, low)

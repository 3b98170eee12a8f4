"""Readers, writers and contract checks for the tables operators work on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.functions.numeric import clip, finite
from terrascope.functions.rigid import POSE, ROTATION, TRANSLATION, pose_matrix, rotate, transpose, with_rotation
from terrascope.functions.single import attach
from terrascope.functions.text import render_template, safe_label
from terrascope.functions.vectors import l2_normalize, times_matrix
from terrascope.operators.ordered import bucket_width, with_positions
from terrascope.session import cut_lineage

# Accepted document tags.
PROMPT_GROUP_SCHEMAS = ("mcd_open_vocab_prompt_groups_v1", "mcd_open_vocab_prompt_groups_v2")
QUERY_SCHEMA = "pca_text_queries_v2"

PROMPT_DOCUMENT = (
    "schema string, frozen_before_heldout_evaluation boolean, primary_macro_class_ids array<int>, "
    "classes map<string, struct<name: string, queries: array<string>>>"
)
QUERY_DOCUMENT = (
    "schema string, queries array<struct<label: string, prompt: string, feature: array<float>, "
    "mean_dot: double, basis_dot: array<double>>>, "
    "negatives array<struct<prompt: string, feature: array<float>, mean_dot: double, basis_dot: array<double>>>"
)


# --- poses -------------------------------------------------------------------------

def parse_pose_lines(lines: DataFrame, pose_type: str = "wc") -> DataFrame:
    """Pose rows from text lines; ``cw``/``colmap`` poses are inverted.

    Blank and ``#`` lines are skipped; a line that does not parse stops the job.
    """
    if pose_type not in ("wc", "cw", "colmap"):
        raise ValueError(f"unsupported pose type: {pose_type}")
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = lines.select(line.alias("_line")).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    fields = F.split("_line", " ")
    numbers = [F.get(fields, F.lit(i + 2)).try_cast("double") for i in range(7)]
    broken = numbers[0].isNull()
    for number in numbers[1:]:
        broken = broken | number.isNull()
    typed = parts.select(
        F.get(fields, F.lit(0)).alias("image"),
        F.get(fields, F.lit(1)).alias("cloud"),
        *[
            F.when(broken, F.raise_error(F.concat(F.lit("invalid pose line: "), "_line")).cast("double"))
            .otherwise(number)
            .alias(name)
            for number, name in zip(numbers, POSE)
        ],
    )
    return typed if pose_type == "wc" else invert_poses(typed)


def invert_poses(poses: DataFrame) -> DataFrame:
    """World-to-camera pose to camera-to-world: conjugate rotation, -R^T t."""
    copied = [f"{c} as _copy_{c}" for c in ROTATION]
    turned = with_rotation(poses.selectExpr("*", *copied))
    back = rotate(transpose(pose_matrix()), TRANSLATION)
    length = "sqrt(" + " + ".join(f"_copy_{c} * _copy_{c}" for c in ROTATION) + ")"
    changed = {c: f"{'' if c == 'qw' else '-'}_copy_{c} / {length}" for c in ROTATION}
    changed |= {n: f"-{v}" for n, v in zip(TRANSLATION, back)}
    return turned.selectExpr(*[f"{changed.get(c, c)} as {c}" for c in poses.columns])


def read_pose_manifest(spark: SparkSession, path: str, pose_type: str = "wc") -> DataFrame:
    poses = parse_pose_lines(spark.read.text(path), pose_type)
    if poses.isEmpty():
        raise ValueError("no frames in the pose manifest")
    return poses


# --- alignment ------------------------------------------------------------------------

def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    absent = {"frame_index", "label_scan_index"} - set(raw.columns)
    if absent:
        raise ValueError(f"alignment lacks columns: {sorted(absent)}")
    return raw.select(F.col("frame_index").cast("int"), F.col("label_scan_index").cast("int"))


def duplicate_frames(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("frame_index").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def alignment_table(alignment: DataFrame, row_order: str | None = None) -> DataFrame:
    """One scan per frame: the last row wins by ``row_order``; without it duplicates fail."""
    if row_order:
        return alignment.groupBy("frame_index").agg(F.max_by("label_scan_index", row_order).alias("label_scan_index"))
    rows = alignment.groupBy("frame_index").agg(
        F.max("label_scan_index").alias("label_scan_index"), F.count(F.lit(1)).alias("_rows")
    )
    duplicate = F.raise_error(F.concat(F.lit("duplicate alignment frame: "), F.col("frame_index").cast("string")))
    return rows.select(
        "frame_index",
        F.when(F.col("_rows") > 1, duplicate.cast("int")).otherwise(F.col("label_scan_index")).alias("label_scan_index"),
    )


# --- prompts and query vectors ------------------------------------------------------

def prompt_classes(documents: DataFrame, column: str = "document") -> DataFrame:
    """(class_id, class_order, name, query, safe_query) of the primary classes."""
    parsed = documents.select(F.from_json(column, PROMPT_DOCUMENT).alias("d"))
    primary = parsed.select(
        F.posexplode("d.primary_macro_class_ids").alias("class_order", "class_id"), F.col("d.classes").alias("classes")
    )
    record = F.try_element_at("classes", F.col("class_id").cast("string"))
    return primary.select("class_id", "class_order", record["name"].alias("name"), F.explode(record["queries"]).alias("query")).select(
        "*", safe_label(F.col("query")).alias("safe_query")
    )


def prompt_violations(documents: DataFrame, column: str = "document") -> DataFrame:
    """(problem, subject) rows; empty when the prompt document is usable."""
    parsed = documents.select(F.from_json(column, PROMPT_DOCUMENT).alias("d"))
    primary = parsed.select(F.explode("d.primary_macro_class_ids").alias("class_id"), F.col("d.classes").alias("classes"))
    record = F.try_element_at("classes", F.col("class_id").cast("string"))

    def problem(df: DataFrame, name: str, subject: Column) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), subject.cast("string").alias("subject"))

    empty = F.coalesce(F.size(record["queries"]), F.lit(0)) <= 0
    twice = primary.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clash = (
        prompt_classes(documents, column)
        .groupBy("safe_query")
        .agg(F.count_distinct("query").alias("n"))
        .where("n > 1")
    )
    frozen = F.coalesce(F.col("d.frozen_before_heldout_evaluation"), F.lit(False))
    return (
        problem(parsed.where(~F.coalesce(F.col("d.schema").isin(*PROMPT_GROUP_SCHEMAS), F.lit(False))), "schema", F.col("d.schema"))
        .unionByName(problem(parsed.where(~frozen), "not_frozen", F.col("d.schema")))
        .unionByName(problem(primary.where(record.isNull()), "missing_class", F.col("class_id")))
        .unionByName(problem(primary.where(record.isNotNull() & empty), "no_query", F.col("class_id")))
        .unionByName(problem(twice, "duplicate_class", F.col("class_id")))
        .unionByName(problem(clash, "label_collision", F.col("safe_query")))
    )


def label_collisions(labels: DataFrame, column: str) -> DataFrame:
    """Safe labels shared by different labels."""
    return (
        labels.select(F.col(column).alias("label"), safe_label(F.col(column)).alias("safe"))
        .groupBy("safe")
        .agg(F.count_distinct("label").alias("labels"))
        .where(F.col("labels") > 1)
    )


def query_vectors(documents: DataFrame, column: str = "document") -> DataFrame:
    """(kind, label, prompt, feature, mean_dot, basis_dot) with unit features."""
    parsed = documents.select(F.from_json(column, QUERY_DOCUMENT).alias("d"))
    positives = parsed.select(F.inline("d.queries")).withColumn("kind", F.lit("positive"))
    negatives = parsed.select(F.inline("d.negatives")).withColumn("kind", F.lit("negative"))
    both = positives.unionByName(negatives, allowMissingColumns=True)
    return both.select("kind", "label", "prompt", l2_normalize(F.col("feature")).alias("feature"), "mean_dot", "basis_dot")


def query_violations(vectors: DataFrame, required: DataFrame) -> DataFrame:
    """(problem, subject): missing prompts, duplicate labels, unequal dimensions, no negatives."""
    positives = vectors.where(F.col("kind") == "positive")

    def problem(df: DataFrame, name: str, subject: Column) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), subject.cast("string").alias("subject"))

    missing = required.select(F.col("query").alias("label")).distinct().join(positives, "label", "left_anti")
    twice = positives.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = vectors.agg(F.count_distinct(F.size("feature")).alias("n")).where("n > 1")
    none = vectors.agg(F.coalesce(F.sum((F.col("kind") == "negative").cast("int")), F.lit(0)).alias("n")).where("n = 0")
    return (
        problem(missing, "missing_prompt", F.col("label"))
        .unionByName(problem(twice, "duplicate_label", F.col("label")))
        .unionByName(problem(sizes, "dimension", F.col("n")))
        .unionByName(problem(none, "no_negatives", F.col("n")))
    )


def prompts_from_template(queries: DataFrame, template: str) -> DataFrame:
    return queries.select("*", render_template(template, F.col("query")).alias("prompt"))


def repeated_queries(queries: DataFrame) -> DataFrame:
    """Query count against distinct count; equal when queries are globally unique."""
    return queries.agg(F.count("query").alias("queries"), F.count_distinct("query").alias("distinct_queries"))


# --- rasters and regions --------------------------------------------------------------

def write_region_tables(regions: DataFrame, pixels: DataFrame, path: str, frames_per_bucket: int = 256) -> None:
    """Region rows and region pixels in frame buckets, so a frame range prunes files."""
    for name, df in (("regions", regions), ("region_pixels", pixels)):
        bucketed = df.withColumn("frame_bucket", F.floor(F.col("frame_index") / frames_per_bucket).cast("int"))
        (
            bucketed.repartitionByRange("frame_bucket", "frame_index")
            .write.mode("errorifexists")
            .partitionBy("frame_bucket")
            .parquet(f"{path}/{name}")
        )


def read_region_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/regions"), spark.read.parquet(f"{path}/region_pixels")


def region_inventory(regions: DataFrame) -> DataFrame:
    """Per frame: region count and the ranges the table promises."""
    return regions.groupBy("frame_index").agg(
        F.count(F.lit(1)).alias("regions"),
        F.min(F.size("feature")).alias("dimension"),
        F.max("region").alias("last_region"),
        F.min("predicted_iou").alias("min_predicted_iou"),
        F.max("stability").alias("max_stability"),
    )


def raster_contract(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Per frame: pixels outside the image, bytes out of range, repeated addresses."""
    outside = ~(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    out_of_range = ~(F.col("ref").between(0, 255) & F.col("conf_u8").between(0, 255) & F.col("alpha").between(0, 255))
    per_address = pixels.groupBy("frame_index", "u", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(outside.cast("bigint")).alias("outside"),
        F.sum(out_of_range.cast("bigint")).alias("out_of_range"),
    )
    return per_address.groupBy("frame_index").agg(
        F.sum("n").alias("pixels"),
        F.sum("outside").alias("outside"),
        F.sum("out_of_range").alias("out_of_range"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("repeated"),
    )


def missing_rasters(frames: DataFrame, queries: DataFrame, present: DataFrame) -> DataFrame:
    """(frame, query) pairs without a raster.

    ``queries`` is the short list of one prompt document; it is attached to each
    frame as an array and exploded.
    """
    listed = queries.agg(F.collect_set("query").alias("_all"))
    wanted = (
        attach(frames, listed)
        .select("frame_index", F.explode("_all").alias("query"))
    )
    return wanted.join(present.select("frame_index", "query").distinct(), ["frame_index", "query"], "left_anti")


# --- map export -----------------------------------------------------------------------

def map_attributes(points: DataFrame, arrays: dict[str, tuple[str, int]]) -> DataFrame:
    """Flatten array columns to numbered scalars: {column: (prefix, length)}."""
    scalars = [F.col(c) for c in points.columns if c not in arrays]
    numbered = [
        F.get(F.col(column), F.lit(i)).cast("float").alias(f"{prefix}_{i}")
        for column, (prefix, length) in arrays.items()
        for i in range(length)
    ]
    return points.select(*scalars, *numbered)


def write_map(points: DataFrame, path: str) -> None:
    points.write.mode("errorifexists").parquet(path)


# --- message index ----------------------------------------------------------------------

def message_index(topics: DataFrame, messages: DataFrame, topic: str) -> DataFrame:
    """Zero-based index of a topic's messages by time, with seconds.

    Numbered inside time buckets and shifted by the count of earlier buckets.
    """
    chosen = topics.where(F.col("name") == topic).select(F.col("id").alias("topic_id"))
    width = bucket_width(messages, F.col("timestamp_ns"))
    timed = messages.join(chosen, "topic_id", "left_semi").withColumn(
        "_b", F.floor(F.col("timestamp_ns") / F.lit(width)).cast("bigint")
    )
    indexed = with_positions(timed, ["topic_id"], "_b", [F.col("timestamp_ns"), F.col("message_id")], "scan_index")
    return indexed.select(
        "scan_index", "message_id", "timestamp_ns", (F.col("timestamp_ns") * 1e-9).alias("seconds")
    )


# --- sinks ------------------------------------------------------------------------------

def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report table; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "parquet"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported report format: {fmt}")


# --- provenance ---------------------------------------------------------------------------

#: Bytes up to which a file passes as one value; larger ones are streamed.
WHOLE = 64 << 20


def file_digests(spark: SparkSession, path: str, root: str, glob: str | None = None) -> DataFrame:
    """SHA-256 per file with its name relative to ``root``.

    A file of more than ``WHOLE`` bytes is streamed through its task in the pieces between its
    line ends, so it may be larger than a value can be. One task reads it from start to end,
    as the digest is one chain. Compressed files and those that Spark's text reader does not
    give back byte for byte pass as one value whatever their size.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    relative = F.expr(f"substring(regexp_replace(path, '^(file:)?/*', '/'), {len(root.rstrip('/')) + 2})").alias("name")
    length = F.col("length")
    found = reader.load(path).where(length <= WHOLE).select(relative, F.sha2("content", 256).alias("digest"))
    large = {r.path: r.length for r in reader.load(path).where(length > WHOLE).select("path", "length").collect()}  # a row per large file
    plain = {p: n for p, n in large.items() if not set("*?[]{}\\") & set(p) and not _compressed(spark, p)}
    if plain:
        streamed = _streamed_digests(spark, plain)
        done = [r.path for r in streamed.where("digest is not null").select("path").collect() if r.path in plain]
        found = found.union(streamed.where(F.col("path").isin(done) & F.col("digest").isNotNull()).select(relative, "digest"))
        large = {p: n for p, n in large.items() if p not in set(done)}
    if large:
        # The reader takes lengths as a condition, so it leaves all other files closed.
        rest = reader.load(path).where(reduce(or_, (length == n for n in set(large.values())))).where(F.col("path").isin(list(large)))
        found = found.union(rest.select(relative, F.sha2("content", 256).alias("digest")))
    return found


def _compressed(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop
    return hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hadoop.fs.Path(path)) is not None


def _streamed_digests(spark: SparkSession, files: dict[str, int]) -> DataFrame:
    """``path, digest``, written once; the digest is null where the pieces do not add up to the file."""
    lines = spark.read.option("lineSep", "\n").text(list(files))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, seen, sha = None, 0, 0, hashlib.sha256()

        def ended() -> pa.RecordBatch:
            # Only whether the last line has an end is unknown.
            if seen == size - 1:
                sha.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([unquote(path)], pa.string()), pa.array([sha.hexdigest() if seen in (size - 1, size) else None], pa.string())], ["path", "digest"])

        for batch in batches:
            at = 0
            for run_end in pc.run_end_encode(batch.column(0)).run_ends.to_pylist():
                piece = batch.slice(at, run_end - at)
                at = run_end
                data = b"\n".join(piece.column(2).to_pylist())
                if piece.column(0)[0].as_py() == path:
                    data = b"\n" + data
                else:
                    if path is not None:
                        yield ended()
                    path, size, seen, sha = piece.column(0)[0].as_py(), piece.column(1)[0].as_py(), 0, hashlib.sha256()
                sha.update(data)
                seen += len(data)
        if path is not None:
            yield ended()

    # One split for each file; the settings are put back when the digests are written.
    whole = {"spark.sql.files.maxPartitionBytes": str(max(files.values())), "spark.sql.files.minPartitionNum": "1"}
    usual = {k: spark.conf.get(k, None) for k in whole}
    for k, v in whole.items():
        spark.conf.set(k, v)
    try:
        return cut_lineage(lines.mapInArrow(run, "path string, digest string"), "digests")
    finally:
        for k, v in usual.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def combined_digest(digests: DataFrame) -> DataFrame:
    """One SHA-256 over (name, NUL, raw digest) of all files, sorted by name.

    Rows are (name, 64 hex digits): a few dozen bytes per file, one row per file of a
    run's inputs. The fold itself is sequential by definition.
    """
    entries = F.array_sort(F.collect_list(F.struct("name", "digest")))
    joined = F.aggregate(
        entries,
        F.lit(""),
        lambda acc, e: F.concat(acc, F.hex(F.encode(e["name"], "UTF-8")), F.lit("00"), e["digest"]),
    )
    return digests.agg(F.sha2(F.unhex(joined), 256).alias("combined"), F.count(F.lit(1)).alias("files"))


# --- compressed supervision targets ------------------------------------------------------

def pca_targets(regions: DataFrame, mean, basis) -> DataFrame:
    """Per region: vector . basis, vector . mean and confidence; ids shifted by one."""
    unit = regions.withColumn("_x", l2_normalize(F.col("feature")))
    return unit.select(
        "frame_index",
        (F.col("region") + 1).alias("region_id"),
        times_matrix(F.col("_x"), basis).alias("basis_dot"),
        F.get(times_matrix(F.col("_x"), mean.reshape(-1, 1)), F.lit(0)).alias("mean_dot"),
        F.sqrt(clip(F.col("predicted_iou") * F.col("stability"), 0.0, 1.0)).alias("confidence"),
    )


def shifted_segmentation(pixels: DataFrame) -> DataFrame:
    """Region ids +1, 0 = unsupervised."""
    return pixels.withColumn("region_id", F.greatest(F.col("region") + 1, F.lit(0)))


def target_violations(targets: DataFrame, segmentation: DataFrame, dimension: int) -> DataFrame:
    """Count of broken target rows and of pixels naming an absent target row."""
    bad_row = (
        (F.size("basis_dot") != dimension)
        | F.exists("basis_dot", lambda x: ~finite(x))
        | ~finite(F.col("mean_dot"), F.col("confidence"))
    )
    rows = targets.agg(F.coalesce(F.sum(bad_row.cast("bigint")), F.lit(0)).alias("bad")).select(
        F.lit("bad_target_rows").alias("test_name"), "bad"
    )
    used = segmentation.where(F.col("region_id") > 0).select("frame_index", "region_id").distinct()
    absent = used.join(targets, ["frame_index", "region_id"], "left_anti")
    return rows.unionByName(
        absent.agg(F.count(F.lit(1)).alias("bad")).select(F.lit("absent_target_rows").alias("test_name"), "bad")
    )


def mean_norm_gap(mean_rows: DataFrame, stored: float, tolerance: float = 1e-5) -> DataFrame:
    """Recomputed squared norm of the mean against the stored constant."""
    return mean_rows.agg(F.sum(F.col("value") * F.col("value")).alias("recomputed")).select(
        "recomputed", (F.abs(F.col("recomputed") - F.lit(stored)) <= tolerance).alias("consistent")
    )



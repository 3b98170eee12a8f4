"""Queries over sources, frame selection and temporal alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions import text
from terrascope.operators import frames as fr
from terrascope.plans.evaluation_queries import SPLITS, splits
from terrascope.plans.inputs import Inputs
from terrascope.plans.registry import query
from terrascope.session import shared_path
from terrascope.sources import tables as tb

TOLERANCE_S = 600.0

# Cosine basis used wherever a fixed basis is needed: width 64, 16 components.
WIDTH, COMPONENTS = 64, 16
BASIS = np.array(
    [[np.sqrt(2.0 / WIDTH) * np.cos(np.pi * (i + 0.5) * k / WIDTH) for k in range(1, COMPONENTS + 1)] for i in range(WIDTH)]
)
BASIS_SQL = f"(select i.range as i, k.range as k, sqrt(2.0 / {WIDTH}) * cos(pi() * (i.range + 0.5) * k.range / {WIDTH}) as b from range({WIDTH}) i, range(1, {COMPONENTS + 1}) k)"
MEAN = np.array([0.01 * np.sin(i * 0.7) for i in range(WIDTH)])
MEAN_SQL = f"(select range as i, 0.01 * sin(range * 0.7) as m from range({WIDTH}))"


# --- sources ------------------------------------------------------------------------

@query(
    "pose_manifest_wc",
    "image:s qw:d qx:d qy:d qz:d tx:d ty:d tz:d",
    "select 'image_' || frame_index || '.png' as image, qw, qx, qy, qz, tx, ty, tz from {fx_poses}",
)
def _(t: Inputs) -> DataFrame:
    """Poses written as manifest lines, with comments and blanks, and parsed back."""
    pose = t["fx_poses"]
    fields = [F.format_string("%.17g", F.col(n)) for n in fr.POSE]
    line = F.concat_ws(" ", F.concat(F.lit("image_"), F.col("frame_index"), F.lit(".png")), F.lit("cloud.pcd"), *fields)
    lines = pose.select(F.explode(F.array(line, F.lit("  # note"), F.lit("   "))).alias("value"))
    return tb.parse_pose_lines(lines, "wc")


@query(
    "pose_manifest_cw",
    "frame_index:i qw:d qx:d qy:d qz:d tx:d ty:d tz:d",
    """with n as (select *, qw * qw - qy * qy as c2, 2 * qw * qy as s2 from {fx_poses})
    select frame_index, qw, -qx as qx, -qy as qy, -qz as qz, -(c2 * tx - s2 * tz) as tx, -ty as ty, -(s2 * tx + c2 * tz) as tz from n""",
)
def _(t: Inputs) -> DataFrame:
    return tb.invert_poses(t["fx_poses"])


@query(
    "alignment_table",
    "frame_index:i label_scan_index:i",
    """select frame_index, label_scan_index from (select cast(floor(l_orderkey / 250) as int) as frame_index, l_partkey as label_scan_index,
      row_number() over (partition by floor(l_orderkey / 250) order by l_orderkey desc, l_linenumber desc, l_partkey desc) as rn from {lineitem}) r where rn = 1""",
)
def _(t: Inputs) -> DataFrame:
    """Many rows per frame, the last one wins."""
    rows = t["lineitem"].select(
        F.floor(F.col("l_orderkey") / 250).cast("int").alias("frame_index"),
        F.col("l_partkey").cast("int").alias("label_scan_index"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row_no"),
    )
    return tb.alignment_table(rows, "row_no")


@query("alignment_unique", "frame_index:i label_scan_index:i", "select * from {fx_alignment}")
def _(t: Inputs) -> DataFrame:
    return tb.alignment_table(t["fx_alignment"])


def prompt_documents(t: Inputs) -> DataFrame:
    """Prompt-group documents from the part types and names: one per type and thousand part keys.

    Every type is a class of its own, numbered in order of name; the window runs over the
    types. No document grows with the table.
    """
    types = t["part"].select("p_type").distinct().withColumn("class_id", F.dense_rank().over(Window.orderBy("p_type")))
    kinds = t["part"].groupBy("p_type", F.floor(F.col("p_partkey") / 1000)).agg(F.sort_array(F.collect_set("p_name")).alias("queries"))
    return kinds.join(types, "p_type").select(
        F.to_json(
            F.struct(
                F.lit("mcd_open_vocab_prompt_groups_v2").alias("schema"), F.lit(True).alias("frozen_before_heldout_evaluation"),
                F.array("class_id").alias("primary_macro_class_ids"),
                F.create_map(F.col("class_id").cast("string"), F.struct(F.col("p_type").alias("name"), F.col("queries"))).alias("classes"),
            )
        ).alias("document")
    )


def prompts(t: Inputs) -> DataFrame:
    """Classes and queries of all documents; a name that several documents of a class hold comes once."""
    return tb.prompt_classes(prompt_documents(t)).drop("class_order").distinct()


@query(
    "prompt_classes",
    "class_id:i name:s query:s safe_query:s",
    """with ty as (select p_type, dense_rank() over (order by p_type) as class_id from {part} group by p_type)
    select distinct ty.class_id, p_type as name, p.p_name as query, replace(p.p_name, ' ', '_') as safe_query from ty join {part} p using (p_type)""",
)
def _(t: Inputs) -> DataFrame:
    return prompts(t)


@query(
    "query_vectors",
    "kind:s label:s norm2:d first:d",
    """with p as (select *, list_dot_product(feature::double[], feature::double[]) as n2 from {fx_prompts})
    select case when class_id >= 0 then 'positive' else 'negative' end as kind,
      case when class_id >= 0 then class_id || '-' || query_id end as label, 1.0 as norm2, feature[1] / sqrt(n2) as first from p""",
)
def _(t: Inputs) -> DataFrame:
    record = F.struct(
        F.concat_ws("-", "class_id", "query_id").alias("label"), F.lit("a prompt").alias("prompt"), F.col("feature"),
        F.lit(0.0).alias("mean_dot"), F.array(F.lit(0.0)).alias("basis_dot"),
    )
    positive, negative = F.when(F.col("class_id") >= 0, record), F.when(F.col("class_id") < 0, record)
    documents = t["fx_prompts"].groupBy("class_id").agg(
        F.to_json(
            F.struct(F.lit(tb.QUERY_SCHEMA).alias("schema"), F.collect_list(positive).alias("queries"), F.collect_list(negative).alias("negatives"))
        ).alias("document")
    )
    from terrascope.functions.vectors import norm2

    return tb.query_vectors(documents).withColumn("norm2", norm2(F.col("feature"))).withColumn("first", F.get("feature", F.lit(0)))


@query(
    "region_table",
    "frame_index:i regions:i dimension:i last_region:i min_predicted_iou:d max_stability:d",
    """select frame_index, count(*) as regions, min(len(feature)) as dimension, max(region) as last_region,
      min(predicted_iou) as min_predicted_iou, max(stability) as max_stability from {fx_regions} group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    """Written in frame buckets, read back."""
    path = shared_path(t.spark, "regions")
    tb.write_region_tables(t["fx_regions"], t["fx_pixels"], path)
    return tb.region_inventory(tb.read_region_tables(t.spark, path)[0])


@query(
    "label_rasters",
    "frame_index:i pixels:i outside:i out_of_range:i repeated:i",
    """select frame_index, sum(n) as pixels, sum(case when u > 60 or v > 40 then n else 0 end) as outside,
      sum(case when ref > 255 or conf_u8 > 255 then n else 0 end) as out_of_range, sum(case when n > 1 then 1 else 0 end) as repeated
      from (select frame_index, u, v, ref, conf_u8, count(*) as n from {fx_pixels} group by frame_index, u, v, ref, conf_u8) x group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    return tb.raster_contract(t["fx_pixels"], 61, 41)


@query(
    "missing_rasters",
    "frame_index:i query:i",
    """with f as (select distinct frame_index from {fx_pixels}), q as (select distinct ref as query from {fx_pixels}),
    p as (select distinct frame_index, ref as query from {fx_pixels} where conf_u8 > 200 and (ref + frame_index) % 3 > 0)
    select f.frame_index, q.query from f cross join q where not exists (select 1 from p where p.frame_index = f.frame_index and p.query = q.query)""",
)
def _(t: Inputs) -> DataFrame:
    pixels = t["fx_pixels"]
    frames = pixels.select("frame_index").distinct()
    queries = pixels.select(F.col("ref").alias("query")).distinct()
    present = pixels.where((F.col("conf_u8") > 200) & ((F.col("ref") + F.col("frame_index")) % 3 > 0)).select("frame_index", F.col("ref").alias("query"))
    return tb.missing_rasters(frames, queries, present)


@query(
    "map_attributes",
    "vec_id:i opacity:d language_pca_0:d language_pca_15:d language_pca_63:d columns:i",
    "select vec_id, predicted_iou as opacity, feature[1] as language_pca_0, feature[16] as language_pca_15, feature[64] as language_pca_63, 66 as columns from {fx_regions}",
)
def _(t: Inputs) -> DataFrame:
    points = t["fx_regions"].select("vec_id", F.col("predicted_iou").alias("opacity"), "feature")
    flat = tb.map_attributes(points, {"feature": ("language_pca", 64)})
    path = shared_path(t.spark, "map")
    tb.write_map(flat, path)
    back = t.spark.read.parquet(path)
    return back.withColumn("columns", F.lit(len(back.columns)))


@query(
    "message_index",
    "scan_index:i message_id:i seconds:d",
    """select row_number() over (order by epoch_us(ts), event_id) - 1 as scan_index, event_id as message_id, epoch_us(ts) * 1000 * 1e-9 as seconds
    from {events} where event_type = 'error'""",
)
def _(t: Inputs) -> DataFrame:
    events = t["events"]
    topics = events.select("event_type").distinct().select(F.length("event_type").alias("id"), F.col("event_type").alias("name"))
    numbered = topics.groupBy("name").agg(F.crc32(F.first("name")).alias("id"))
    messages = events.select(
        F.crc32("event_type").alias("topic_id"), F.col("event_id").alias("message_id"), (fr.micros(F.col("ts")) * 1000).alias("timestamp_ns")
    )
    return tb.message_index(numbered, messages, "error")


@query(
    "metric_sinks",
    "split:s frames:i",
    f"select split, count(*) as frames from ({SPLITS}) s group by split",
)
def _(t: Inputs) -> DataFrame:
    """Report written as CSV and JSON, read back from JSON."""
    report = splits(t).groupBy("split").agg(F.count(F.lit(1)).alias("frames"))
    path = shared_path(t.spark, "report")
    tb.write_report(report, f"{path}/per_frame.csv", "csv")
    tb.write_report(report, f"{path}/summary.json", "json")
    return t.spark.read.schema("split string, frames bigint").json(f"{path}/summary.json")


@query(
    "provenance_digest",
    "name:s digest:s",
    "select 'doc-' || doc_id as name, sha256(text) as digest from {documents}",
)
def _(t: Inputs) -> DataFrame:
    """Digest of every document's bytes."""
    return t["documents"].select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.sha2("text", 256).alias("digest"))


@query("provenance_files", "files:i combined:s")
def _(t: Inputs) -> DataFrame:
    """Combined digest of the table files themselves."""
    return tb.combined_digest(tb.file_digests(t.spark, t.folder, t.folder, "*.parquet"))


@query(
    "safe_label",
    "doc_id:i safe:s",
    """select doc_id, case when s = '' then 'query' else s end as safe from (select doc_id,
      regexp_replace(regexp_replace(lang || '/' || source || ':' || text, '[^\\x00-\\x7F]', '@@', 'g'), '[^0-9A-Za-z_-]', '_', 'g') as s from {documents}) x""",
)
def _(t: Inputs) -> DataFrame:
    label = F.concat("lang", F.lit("/"), "source", F.lit(":"), "text")
    return t["documents"].select("doc_id", text.safe_label(label).alias("safe"))


@query(
    "label_collisions",
    "safe:s labels:i",
    "select replace(p_name, ' ', '_') as safe, 2 as labels from {part} group by p_name",
)
def _(t: Inputs) -> DataFrame:
    """Every part name against its hyphen-free twin: each pair collides."""
    names = t["part"].select(F.explode(F.array("p_name", F.translate("p_name", " ", "."))).alias("label"))
    return tb.label_collisions(names, "label")


@query(
    "pca_target_table",
    "frame_index:i region_id:i basis_dot_1:d basis_dot_16:d mean_dot:d confidence:d",
    f"""with x as (select frame_index, region, predicted_iou, stability, generate_subscripts(feature, 1) - 1 as i, unnest(feature)::double as v from {{fx_regions}}),
    n as (select frame_index, region, sqrt(sum(v * v)) as len from x group by frame_index, region),
    d as (select x.frame_index, x.region, sum(case when b.k = 1 then v * b.b else 0 end) as b1, sum(case when b.k = 16 then v * b.b else 0 end) as b16
      from x join {BASIS_SQL} b on x.i = b.i group by x.frame_index, x.region),
    e as (select x.frame_index, x.region, sum(v * m.m) as md, min(predicted_iou * stability) as ps from x join {MEAN_SQL} m on x.i = m.i group by x.frame_index, x.region)
    select d.frame_index, d.region + 1 as region_id, b1 / len as basis_dot_1, b16 / len as basis_dot_16, md / len as mean_dot, sqrt(least(greatest(ps, 0), 1)) as confidence
    from d join e on d.frame_index = e.frame_index and d.region = e.region join n on d.frame_index = n.frame_index and d.region = n.region""",
)
def _(t: Inputs) -> DataFrame:
    targets = tb.pca_targets(t["fx_regions"], MEAN, BASIS)
    return targets.select(
        "*", F.get("basis_dot", F.lit(0)).alias("basis_dot_1"), F.get("basis_dot", F.lit(15)).alias("basis_dot_16")
    )


@query(
    "pca_target_checks",
    "test_name:s bad:i",
    """with t as (select distinct frame_index, region + 1 as region_id from {fx_regions}), p as (select distinct frame_index, region + 1 as region_id from {fx_pixels} where region >= 0)
    select 'bad_target_rows' as test_name, 0 as bad union all
    select 'absent_target_rows', (select count(*) from p where not exists (select 1 from t where t.frame_index = p.frame_index and t.region_id = p.region_id))""",
)
def _(t: Inputs) -> DataFrame:
    targets = tb.pca_targets(t["fx_regions"], MEAN, BASIS)
    return tb.target_violations(targets, tb.shifted_segmentation(t["fx_pixels"]), COMPONENTS)


# --- alignment ----------------------------------------------------------------------------

NEAREST = f"""nn as (select f.frame_id, s.scan_id, abs(epoch_us(f.ts) - epoch_us(s.ts)) as gap,
    row_number() over (partition by f.frame_id order by abs(epoch_us(f.ts) - epoch_us(s.ts)), epoch_us(s.ts),
      case when epoch_us(s.ts) < epoch_us(f.ts) then -s.scan_id else s.scan_id end) as rn
  from {{fx_frames}} f, {{fx_scans}} s where epoch_us(s.ts) between epoch_us(f.ts) - 86400000000 * 4 and epoch_us(f.ts) + 86400000000 * 4),
 nm as (select frame_id, case when gap <= {int(TOLERANCE_S * 1e6)} then scan_id else -1 end as scan_id, gap / 1e6 as gap_s from nn where rn = 1)"""


def matches(t: Inputs) -> DataFrame:
    return fr.nearest_scan(t["fx_frames"], t["fx_scans"], TOLERANCE_S)


@query("nearest_scan", "frame_id:i scan_id:i gap_s:d", f"with {NEAREST} select * from nm")
def _(t: Inputs) -> DataFrame:
    return matches(t)


@query(
    "nearest_scan_stats",
    "frames:i matched_frames:i mean_gap_s:d max_gap_s:d",
    f"with {NEAREST} select count(*) as frames, sum(case when scan_id >= 0 then 1 else 0 end) as matched_frames, avg(case when scan_id >= 0 then gap_s end) as mean_gap_s, max(case when scan_id >= 0 then gap_s end) as max_gap_s from nm",
)
def _(t: Inputs) -> DataFrame:
    return fr.nearest_scan_stats(matches(t))


@query(
    "keyframe_flag",
    "frame_index:i keyframe:b mapper:b",
    "select frame_index, frame_index % 5 = 4 as keyframe, (frame_index + 1) % 5 = 0 as mapper from {fx_alignment}",
)
def _(t: Inputs) -> DataFrame:
    frame = F.col("frame_index")
    return t["fx_alignment"].select(frame, fr.keyframe(frame, 5, 4).alias("keyframe"), fr.mapper_keyframe(frame, 5).alias("mapper"))


@query("disjoint_scan_split", "frame_index:i label_scan_index:i split:s", SPLITS)
def _(t: Inputs) -> DataFrame:
    return splits(t)


@query(
    "split_summary",
    "list:s member:i",
    f"""with s as ({SPLITS}) select split || '_frames' as list, frame_index as member from s where split <> 'heldout'
    union all select distinct 'training_label_scans', label_scan_index from s where split = 'train' and label_scan_index >= 0""",
)
def _(t: Inputs) -> DataFrame:
    return fr.split_members(splits(t))


@query(
    "split_sizes",
    "split:s frames:i scans:i first_frame:i last_frame:i",
    f"""select split, count(*) as frames, count(distinct case when label_scan_index >= 0 then label_scan_index end) as scans, min(frame_index) as first_frame,
    max(frame_index) as last_frame from ({SPLITS}) s group by split""",
)
def _(t: Inputs) -> DataFrame:
    return fr.split_summary(splits(t))


@query(
    "missing_alignment",
    "frame_index:i",
    "select r.range as frame_index from range((select min(frame_index) - 3 from {fx_poses}), (select max(frame_index) + 101 from {fx_poses})) r where r.range not in (select frame_index from {fx_alignment})",
)
def _(t: Inputs) -> DataFrame:
    """Frames around those that have a pose: three before the first, a hundred after the last."""
    first, last = t["fx_poses"].agg(F.min("frame_index"), F.max("frame_index")).first()
    return fr.missing_alignment(t["fx_alignment"], (first or 0) - 3, (last or 0) + 100)


@query(
    "frame_window",
    "frame_index:i emit:b points:i",
    "select frame_index, frame_index <= 24 as emit, count(*) as points from {fx_points} where frame_index between 3 and 27 group by frame_index",
)
def _(t: Inputs) -> DataFrame:
    """The slice itself is the feature: a start, a length and context frames."""
    window = fr.frame_window(t["fx_points"], 3, 22, 3)
    return window.groupBy("frame_index", "emit").agg(F.count(F.lit(1)).alias("points"))


@query(
    "frame_index_from_name",
    "page_id:i plain:i named:i",
    r"""select page_id, coalesce(try_cast(nullif(regexp_extract(regexp_replace(url, '\.[^.]*$', ''), '([0-9]+)$', 1), '') as int), -1) as plain,
    page_id as named from {pages}""",
)
def _(t: Inputs) -> DataFrame:
    named = F.concat(F.lit("seq/left.cam_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".png"))
    return t["pages"].select(
        "page_id", text.frame_index_from_name(F.col("url")).alias("plain"), text.frame_index_from_name(named).alias("named")
    )


SLERP = """case when abs(dt) > 0.9995 then {num} / sqrt((1 - a) * (1 - a) + a * a + 2 * a * (1 - a) * abs(dt)) else
  (sin((1 - a) * ang) * {p} + sin(a * ang) * sg * {q}) / sin(ang) end"""
QUATERNION = ("qw", "qx", "qy", "qz")


def slerp_text(c: str) -> str:
    return SLERP.format(num=f"((1 - a) * p.{c} + a * sg * q.{c})", p=f"p.{c}", q=f"q.{c}")


@query(
    "pose_interpolation",
    "ask_id:i qw:d qx:d qy:d qz:d tx:d ty:d tz:d",
    f"""with pz as (select o.us, p.* from {{fx_poses}} p join (select l_frame, min(us) as us from (
        select cast(floor(l_orderkey / 250) as int) as l_frame, epoch_us(l_shipdate) + l_orderkey * 1000000 as us from {{lineitem}}) m group by l_frame) o on o.l_frame = p.frame_index),
    ps as (select * from pz where us in (select us from pz group by us having count(*) = 1)),
    ask as (select o_orderkey as ask_id, epoch_us(o_orderdate) + 500000 + o_orderkey * 1000 as us from {{orders}}),
    br as (select ask_id, us, (select max(us) from ps where ps.us < ask.us) as b, (select min(us) from ps where ps.us >= ask.us) as c from ask),
    j as (select br.*, case when b is null or c is null then 0.0 else (br.us - b) / (c - b) end as a from br),
    k as (select j.*, p.qw * q.qw + p.qx * q.qx + p.qy * q.qy + p.qz * q.qz as dt from j join ps p on p.us = coalesce(b, c) join ps q on q.us = coalesce(c, b)),
    m as (select *, case when dt < 0 then -1 else 1 end as sg, acos(least(abs(dt), 1.0)) as ang from k)
    select ask_id, {", ".join(f"case when b is null then q.{c} when c is null then p.{c} else {slerp_text(c)} end as {c}" for c in QUATERNION)},
      {", ".join(f"case when b is null then q.{c} when c is null then p.{c} else p.{c} * (1 - a) + q.{c} * a end as {c}" for c in ("tx", "ty", "tz"))}
    from m join ps p on p.us = coalesce(b, c) join ps q on q.us = coalesce(c, b)""",
)
def _(t: Inputs) -> DataFrame:
    """A pose per order instant from one timed pose per frame."""
    timed = (
        t["lineitem"]
        .select(
            F.floor(F.col("l_orderkey") / 250).cast("int").alias("frame_index"),
            (fr.micros(F.col("l_shipdate")) + F.col("l_orderkey") * 1000000).alias("us"),
        )
        .groupBy("frame_index")
        .agg(F.min("us").alias("us"))
    )
    single = timed.groupBy("us").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("frame_index")).where("n = 1")
    poses = single.join(t["fx_poses"], "frame_index").select(F.timestamp_micros("us").alias("ts"), *fr.POSE)
    asked = t["orders"].select(
        F.col("o_orderkey").alias("ask_id"),
        F.timestamp_micros(fr.micros(F.col("o_orderdate")) + 500000 + F.col("o_orderkey") * 1000).alias("ts"),
    )
    return fr.pose_interpolation(asked, poses)


@query(
    "trajectory_resample",
    "out_index:i qw:d qx:d qy:d qz:d tx:d ty:d tz:d",
    f"""with o as (select *, row_number() over (order by frame_index) - 1 as pos from {{fx_poses}}), n as (select count(*) as n, greatest(count(*), 137) as m from o),
    g as (select unnest(range(m)) as i, n, m from n),
    h as (select i as out_index, i * (n - 1) / (m - 1) as place, n from g), w as (select out_index, cast(floor(place) as bigint) as l, least(cast(floor(place) as bigint) + 1, n - 1) as r, place - floor(place) as a from h),
    k as (select w.*, p.qw * q.qw + p.qx * q.qx + p.qy * q.qy + p.qz * q.qz as dt from w join o p on p.pos = l join o q on q.pos = r),
    z as (select *, case when dt < 0 then -1 else 1 end as sg, acos(least(abs(dt), 1.0)) as ang from k)
    select out_index, {", ".join(f"case when l = r or a < 1e-6 then p.{c} else {slerp_text(c)} end as {c}" for c in QUATERNION)},
      {", ".join(f"case when l = r or a < 1e-6 then p.{c} else p.{c} * (1 - a) + q.{c} * a end as {c}" for c in ("tx", "ty", "tz"))}
    from z join o p on p.pos = l join o q on q.pos = r""",
)
def _(t: Inputs) -> DataFrame:
    return fr.trajectory_resample(t["fx_poses"], 137)


@query(
    "strict_holdout_seed",
    "frame_index:i seeds:i",
    "select frame_index, count(*) as seeds from {fx_points} where (frame_index + 1) % 5 = 0 group by frame_index",
)
def _(t: Inputs) -> DataFrame:
    fr.check_holdout_flags(strict=True)
    return fr.seed_points(t["fx_points"], 5, True).groupBy("frame_index").agg(F.count(F.lit(1)).alias("seeds"))


@query(
    "seed_leaks",
    "frame_index:i",
    f"select frame_index from ({SPLITS}) s where split = 'heldout' and frame_index in (select frame_index from {{fx_points}})",
)
def _(t: Inputs) -> DataFrame:
    """Without the strict rule every held-out frame leaks."""
    return fr.seed_leaks(fr.seed_points(t["fx_points"], 5, False), splits(t))


def draw_text(seed: int) -> str:
    return f"(((((frame_index::bigint * 48271 + {seed * 104729 + 12345}) % 2147483647) * ((frame_index::bigint * 48271 + {seed * 104729 + 12345}) % 2147483647)) % 2147483647) * 69621 + frame_index) % 2147483647"


@query(
    "replay_sample",
    "frame_index:i draw_order:i",
    f"select * from (select frame_index, row_number() over (order by {draw_text(7)}, frame_index) as draw_order from {{fx_alignment}}) x where draw_order <= 100",
)
def _(t: Inputs) -> DataFrame:
    return fr.replay_sample(t["fx_alignment"], 100, 7)


@query(
    "replay_sample_decay",
    "frame_index:i stratum:i draw_order:i",
    f"""with o as (select frame_index, case when row_number() over (order by frame_index) - 1 >= floor(count(*) over () * 2 / 3) then 1 else 0 end as stratum from {{fx_alignment}})
    select * from (select frame_index, stratum, row_number() over (partition by stratum order by {draw_text(7)}, frame_index) as draw_order from o) x where draw_order <= 25""",
)
def _(t: Inputs) -> DataFrame:
    return fr.replay_sample_decay(t["fx_alignment"], 100, 7)


@query(
    "long_travel",
    "travel_m:d decay:b",
    """with a as (select * from {fx_poses} order by frame_index limit 1), b as (select * from {fx_poses} order by frame_index desc limit 1)
    select sqrt((b.tx - a.tx) ** 2 + (b.ty - a.ty) ** 2 + (b.tz - a.tz) ** 2) as travel_m, false as decay from a, b""",
)
def _(t: Inputs) -> DataFrame:
    return fr.long_travel(t["fx_poses"])


@query(
    "template_render",
    "class_id:i query:s prompt:s",
    """with ty as (select p_type, dense_rank() over (order by p_type) as class_id from {part} group by p_type)
    select distinct ty.class_id, p.p_name as query, 'a photo of a ' || p.p_name || ' outdoors' as prompt from ty join {part} p using (p_type)""",
)
def _(t: Inputs) -> DataFrame:
    return tb.prompts_from_template(prompts(t), "a photo of a {} outdoors")


@query(
    "query_uniqueness",
    "queries:i distinct_queries:i",
    "with q as (select distinct p_type, p_name from {part}) select count(*) as queries, count(distinct p_name) as distinct_queries from q",
)
def _(t: Inputs) -> DataFrame:
    return tb.repeated_queries(prompts(t))


@query(
    "frame_names",
    "frame_index:i name:s",
    "select frame_index, lpad(cast(frame_index as varchar), 6, '0') || '.png' as name from {fx_alignment}",
)
def _(t: Inputs) -> DataFrame:
    return t["fx_alignment"].select("frame_index", text.frame_name(F.col("frame_index")).alias("name"))

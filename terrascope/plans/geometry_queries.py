"""Queries over point projection, depth rasters and temporal support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.functions.rigid import Intrinsics
from terrascope.operators import geometry as ge
from terrascope.operators.ordered import parts_of
from terrascope.plans.inputs import DERIVED, Inputs
from terrascope.plans.registry import query

CAMERA = Intrinsics(64, 48, 40.0, 40.0, 32.0, 24.0, 80.0, 0.01)
LABEL_CAMERA = Intrinsics(64, 48, 40.0, 40.0, 32.0, 24.0, 80.0, 0.05)
SMALL = Intrinsics(16, 12, 9.7, 9.7, 8.0, 6.0, 80.0, 0.01)
DISTANCE, RADIUS = 0.25, 3

# Sensor-to-camera extrinsic of the label projection example.
EXTRINSIC_R = [[0.995, 0.0, 0.0998749217771909], [0.0, 1.0, 0.0], [-0.0998749217771909, 0.0, 0.995]]
EXTRINSIC_T = [0.02, -0.08, 0.07]


# --- check texts ------------------------------------------------------------------------

def camera_text(points: str, poses: str = "{fx_poses}", on: str = "frame_index") -> str:
    """Camera coordinates through the yaw-only closed form of a rotation about y."""
    return f"""select p.*, (1 - 2 * o.qy * o.qy) * (p.x - o.tx) - 2 * o.qy * o.qw * (p.z - o.tz) as xc, p.y - o.ty as yc,
      2 * o.qy * o.qw * (p.x - o.tx) + (1 - 2 * o.qy * o.qy) * (p.z - o.tz) as zc from {points} p join {poses} o on p.{on} = o.frame_index"""


def pixel_text(source: str, k: Intrinsics, snap: str = "round({})", gate: bool = True) -> str:
    u = snap.format(f"{k.fx} * xc / zc + {k.cx}")
    v = snap.format(f"{k.fy} * yc / zc + {k.cy}")
    depth = f"zc > {k.min_depth} and zc <= {k.max_depth} and" if gate else ""
    return f"""select *, cast(uu as int) as u, cast(vv as int) as v from (select *, {k.fx}::double * xc / zc + {k.cx} as us, {k.fy}::double * yc / zc + {k.cy} as vs,
      {u} as uu, {v} as vv from ({source}) c where zc <> 0) d where {depth} uu between 0 and {k.width - 1} and vv between 0 and {k.height - 1}"""


PROJECTED = pixel_text(camera_text("{fx_points}"), CAMERA)

# The FLOAT depth buffer replayed as a fold in cloud order.
NEAREST = f"""pj as ({PROJECTED}), fm as (select frame_index, u, v, min(zc::float) as depth from pj group by frame_index, u, v),
 cand as (select pj.*, fm.depth, zc < fm.depth::double as below from pj join fm on pj.frame_index = fm.frame_index and pj.u = fm.u and pj.v = fm.v and pj.zc::float = fm.depth),
 nz as (select frame_index, u, v, depth, point_idx, label, x, y, z, r, g, b, us, vs from (select *, row_number() over (partition by frame_index, u, v
   order by below desc, case when below then -point_idx else point_idx end) as rn from cand) w where rn = 1)"""


def projected(t: Inputs) -> DataFrame:
    return ge.project_points(t["fx_points"], t["fx_poses"], CAMERA)


# --- projection ----------------------------------------------------------------------------

@query(
    "world_to_camera", "frame_index:i point_idx:i xc:d yc:d zc:d",
    camera_text("{fx_points}"),
)
def _(t: Inputs) -> DataFrame:
    return ge.world_to_camera(t["fx_points"], t["fx_poses"])


@query("project_points", "frame_index:i point_idx:i u:i v:i us:d vs:d zc:d", PROJECTED)
def _(t: Inputs) -> DataFrame:
    return projected(t)


@query("nearest_z_pixel", "frame_index:i u:i v:i depth:d point_idx:i label:i", f"with {NEAREST} select * from nz")
def _(t: Inputs) -> DataFrame:
    return ge.nearest_z_pixel(projected(t), ["label"])


LABELS = f"""mt as (select frame_index, label_scan_index as scan_id from {{fx_alignment}} where label_scan_index >= 0),
 sp as (select cast(floor(frame_index / 2) + 900 as int) as scan_id, (frame_index % 2) * 1099511627776 + point_idx as point_idx, label, x, y, z from {{fx_points}}),
 po as (select cast(floor(frame_index / 2) + 900 as int) as scan_id, * from {{fx_poses}} where frame_index % 2 = 0),
 se as (select sp.scan_id, point_idx, label, {EXTRINSIC_R[0][0]}::double * x + {EXTRINSIC_R[0][2]}::double * z + {EXTRINSIC_T[0]}::double as x, y + {EXTRINSIC_T[1]}::double as y,
    {EXTRINSIC_R[2][0]}::double * x + {EXTRINSIC_R[2][2]}::double * z + {EXTRINSIC_T[2]}::double as z from sp),
 wo as (select m.frame_index, se.point_idx, se.label, (1 - 2 * o.qy * o.qy) * x + 2 * o.qy * o.qw * z + o.tx as x, y + o.ty as y,
    -2 * o.qy * o.qw * x + (1 - 2 * o.qy * o.qy) * z + o.tz as z from se join po o on se.scan_id = o.scan_id join mt m on m.scan_id = se.scan_id),
 lj as ({pixel_text(camera_text('wo'), LABEL_CAMERA, 'round_even({}, 0)')}),
 lp as (select frame_index, u, v, zc as depth, label + 1 as label, 255 as conf_u8 from (select *, row_number() over (partition by frame_index, u, v order by zc, point_idx) as rn from lj) w where rn = 1)"""


def scan_matches(t: Inputs) -> DataFrame:
    return t["fx_alignment"].select("frame_index", F.col("label_scan_index").alias("scan_id"))


def label_raster(t: Inputs) -> DataFrame:
    scan = (F.floor(F.col("frame_index") / 2) + 900).cast("int").alias("scan_id")
    points = t["fx_points"].select(
        scan, ((F.col("frame_index") % 2) * 1099511627776 + F.col("point_idx")).alias("point_idx"), "label", "x", "y", "z"
    )
    # A scan takes the pose of the even frame it starts in.
    poses = t["fx_poses"].where(F.col("frame_index") % 2 == 0).withColumn("scan_id", scan)
    return ge.label_projection(scan_matches(t), points, poses, t["fx_poses"], EXTRINSIC_R, EXTRINSIC_T, LABEL_CAMERA)


@query("label_projection", "frame_index:i u:i v:i depth:d label:i conf_u8:i", f"with {LABELS} select * from lp")
def _(t: Inputs) -> DataFrame:
    return label_raster(t)


@query(
    "class_pixel_histogram", "class_id:i pixels:i",
    f"with {LABELS} select c as class_id, (select count(*) from lp where label = c) as pixels from (select distinct l_linenumber + 1 as c from {{lineitem}} union select 0) k",
)
def _(t: Inputs) -> DataFrame:
    classes = t["lineitem"].select((F.col("l_linenumber") + 1).alias("class_id")).distinct()
    with_unknown = classes.unionByName(t.spark.range(1).select(F.lit(0).alias("class_id")))
    return ge.class_pixel_histogram(label_raster(t), with_unknown)


@query(
    "labelled_pixel_summary", "matched_frames:i labelled_pixels:i mean_pixels:d",
    f"with {LABELS} select (select count(*) from mt) as matched_frames, count(*) as labelled_pixels, count(*) / (select count(*) from mt) as mean_pixels from lp",
)
def _(t: Inputs) -> DataFrame:
    return ge.labelled_pixel_summary(label_raster(t), scan_matches(t))


@query(
    "stride_sample", "frame_index:i points:i index_sum:i pixels:i",
    f"""with {NEAREST}, s as (select frame_index, count(*) as points, sum(point_idx) as index_sum from (select *, row_number() over (partition by frame_index order by point_idx) - 1 as o from {{fx_points}}) k where o % 4 = 0 group by frame_index),
    p as (select frame_index, count(*) as pixels from nz group by frame_index) select s.frame_index, s.points, s.index_sum, p.pixels from s join p on s.frame_index = p.frame_index""",
)
def _(t: Inputs) -> DataFrame:
    """Every 4th point seeds the map; the depth raster still sees all points."""
    lines = t["lineitem"].drop("l_returnflag", "l_linestatus")
    parts = parts_of(lines)
    points = t.spark.sql(DERIVED["fx_points"], lineitem=lines.repartition(parts, "l_orderkey")).select("frame_index", "point_idx")
    kept = ge.stride_sample(points, 4).groupBy("frame_index").agg(F.count(F.lit(1)).alias("points"), F.sum("point_idx").alias("index_sum"))
    # Both sides, or the fewer parts of the poses would count.
    seen, poses = (t[n].repartition(parts, "frame_index") for n in ("fx_points", "fx_poses"))
    raster = ge.nearest_z_pixel(ge.project_points(seen, poses, CAMERA), []).groupBy("frame_index").agg(F.count(F.lit(1)).alias("pixels"))
    return kept.join(raster, "frame_index")


# --- temporal support ---------------------------------------------------------------------------

SUPPORT = f"""span as (select min(frame_index) as lo, max(frame_index) as hi from {{fx_points}}),
 aa as (select frame_index, point_idx, x, y, z, floor(x / {DISTANCE}) as cx, unnest([-1, 0, 1]) as dx from {{fx_points}}),
 ab as (select *, unnest([-3, -2, -1, 1, 2, 3]) as k from aa),
 bb as (select frame_index, x, y, z, floor(x / {DISTANCE}) as cx from {{fx_points}}),
 hit as (select distinct ab.frame_index, ab.point_idx, k from ab join bb on bb.frame_index = ab.frame_index + ab.k and bb.cx = ab.cx + ab.dx
   where (ab.x - bb.x) * (ab.x - bb.x) + (ab.y - bb.y) * (ab.y - bb.y) + (ab.z - bb.z) * (ab.z - bb.z) <= {DISTANCE * DISTANCE}),
 sup as (select frame_index, point_idx, 1 + count(*) as support, bool_or(k <= -2) as past, bool_or(k >= 2) as future from hit group by frame_index, point_idx),
 sj as (select p.*, coalesce(s.support, 1) as support, coalesce(past, false) as past, coalesce(future, false) as future,
   least(3, least(hi, p.frame_index + 3) - greatest(lo, p.frame_index - 3) + 1) as need,
   p.frame_index >= greatest(lo, p.frame_index - 3) + 2 and least(hi, p.frame_index + 3) >= p.frame_index + 2 as two_sided
   from {{fx_points}} p left join sup s on p.frame_index = s.frame_index and p.point_idx = s.point_idx, span),
 sk as (select *, support >= need and (not two_sided or (past and future)) as kept from sj),
 ts as (select *, case when kept then 'static' when support <= 1 then 'dynamic' else 'uncertain' end as motion from sk)"""


def numbered(t: Inputs) -> DataFrame:
    """The points, of lines that are shuffled as they are stored, before places are worked out."""
    lines = t["lineitem"].drop("l_returnflag", "l_linestatus")
    return t.spark.sql(DERIVED["fx_points"], lineitem=lines.repartition(parts_of(lines), "l_orderkey"))


def supported(t: Inputs, *carry: str) -> DataFrame:
    """Judged points by frame and place; without ``point_idx`` nobody numbers the points."""
    points = numbered(t) if carry else t["fx_points"]
    return ge.temporal_support(points.select("frame_index", *carry, "x", "y", "z"), DISTANCE, RADIUS, 3, 2, True, 1, frames=t["fx_points"])


@query("temporal_support", "frame_index:i point_idx:i support:i kept:b", f"with {SUPPORT} select * from ts")
def _(t: Inputs) -> DataFrame:
    return supported(t, "point_idx")


@query("dynamic_seeds", "frame_index:i point_idx:i motion:s", f"with {SUPPORT} select * from ts where motion <> 'static'")
def _(t: Inputs) -> DataFrame:
    return supported(t, "point_idx").where(F.col("motion") != "static")


@query(
    "temporal_filter_stats", "frame_index:i input_points:i kept_points:i dynamic_points:i keep_ratio:d",
    f"""with {SUPPORT} select frame_index, count(*) as input_points, sum(case when kept then 1 else 0 end) as kept_points,
    sum(case when motion = 'dynamic' then 1 else 0 end) as dynamic_points, sum(case when kept then 1 else 0 end) / count(*) as keep_ratio from ts group by rollup (frame_index)""",
)
def _(t: Inputs) -> DataFrame:
    return ge.temporal_filter_stats(supported(t), t["fx_points"])


DYNAMIC = f"""{SUPPORT}, dp as ({pixel_text(camera_text("(select * from ts where motion = 'dynamic')"), CAMERA)}),
 off as (select a.range as du, b.range as dv from range(-2, 3) a, range(-2, 3) b where a.range * a.range + b.range * b.range <= 4),
 dm as (select distinct frame_index, u + du as u, v + dv as v from dp, off where u + du between 0 and 63 and v + dv between 0 and 47)"""


def dynamic_projected(t: Inputs, judged: DataFrame | None = None) -> DataFrame:
    seeds = (supported(t) if judged is None else judged).where(F.col("motion") == "dynamic").select("frame_index", "x", "y", "z")
    return ge.project_points(seeds, t["fx_poses"], CAMERA)


@query(
    "dynamic_mask", "frame_index:i projected_points:i masked_pixels:i",
    f"""with {DYNAMIC} select a.frame_index, a.n as projected_points, b.n as masked_pixels from (select frame_index, count(*) as n from dp group by frame_index) a
    join (select frame_index, count(*) as n from dm group by frame_index) b on a.frame_index = b.frame_index""",
)
def _(t: Inputs) -> DataFrame:
    return ge.dynamic_mask_stats(ge.dynamic_mask(dynamic_projected(t), 2, CAMERA))


@query(
    "static_pixels", "frame_index:i u:i v:i",
    f"with {DYNAMIC} select frame_index, u, v from {{fx_pixels}} p where not exists (select 1 from dm where dm.frame_index = p.frame_index and dm.u = p.u and dm.v = p.v)",
)
def _(t: Inputs) -> DataFrame:
    return ge.apply_mask(t["fx_pixels"], ge.dynamic_mask(dynamic_projected(t), 2, CAMERA)).select("frame_index", "u", "v")


def fused_text(points: str, low: int, high: int) -> str:
    sent = f"(select q.frame_index + k as frame_index, x, y, z from {points} q, (select unnest(range({low}, {high})) as k) kk)"
    return f"select frame_index, u, v, min(zc::float)::double as depth, count(*) as points from ({pixel_text(camera_text(sent), CAMERA)}) f group by frame_index, u, v"


@query(
    "depth_accumulate_trailing", "frame_index:i u:i v:i depth:d points:i",
    fused_text("{fx_points}", 0, 3),
)
def _(t: Inputs) -> DataFrame:
    return ge.depth_accumulate_trailing(t["fx_points"], t["fx_poses"], CAMERA, 3)


@query(
    "depth_fuse_symmetric", "frame_index:i u:i v:i depth:d points:i",
    f"with {SUPPORT} " + fused_text("(select * from ts where kept)", -3, 4),
)
def _(t: Inputs) -> DataFrame:
    static = supported(t).where("kept").select("frame_index", "x", "y", "z")
    return ge.depth_fuse_symmetric(static, t["fx_poses"], CAMERA, 3)


SMALL_PROJECTED = pixel_text(camera_text("{fx_points}"), SMALL)


@query(
    "bilinear_color", "frame_index:i point_idx:i color:d",
    f"""with s as ({SMALL_PROJECTED}), b as (select frame_index, point_idx, us, vs, least(greatest(floor(us), 0), 15) as u0, least(greatest(floor(vs), 0), 11) as v0 from s),
    c as (select *, us - u0 as du, vs - v0 as dv, least(u0 + 1, 15) as u1, least(v0 + 1, 11) as v1 from b),
    k as (select frame_index, point_idx, u0 as u, v0 as v, (1 - du) * (1 - dv) as w from c union all select frame_index, point_idx, u1, v0, du * (1 - dv) from c
      union all select frame_index, point_idx, u0, v1, (1 - du) * dv from c union all select frame_index, point_idx, u1, v1, du * dv from c)
    select k.frame_index, k.point_idx, sum(w * d.color) as color from k join {{fx_depth}} d on k.frame_index = d.frame_index and k.u = d.u and k.v = d.v group by k.frame_index, k.point_idx""",
)
def _(t: Inputs) -> DataFrame:
    samples = ge.project_points(t["fx_points"], t["fx_poses"], SMALL)
    return ge.bilinear_color(samples, t["fx_depth"], ["frame_index", "point_idx"], SMALL, ["color"])


# --- completion gates -------------------------------------------------------------------------------

PATCH = """ph as (select frame_index, patch_v, patch_u, u, v, predicted from (select frame_index, floor(v / 2) as patch_v, floor(u / 2) as patch_u, u, v, predicted,
   max(measured) over (partition by frame_index, floor(v / 2), floor(u / 2)) as known,
   row_number() over (partition by frame_index, floor(v / 2), floor(u / 2) order by case when predicted > 0 then 0 else 1 end, predicted, v, u) as rn from {source}) w
   where rn = 1 and known <= 0 and predicted > 0)"""


def wanted_depths(t: Inputs) -> DataFrame:
    """Bias-free predicted depth of accepted frames."""
    return ge.completion_gate(t["fx_depth"].select("frame_index", "u", "v", "predicted", "measured"))


@query(
    "patch_holes", "frame_index:i patch_u:i patch_v:i u:i v:i predicted:d",
    "with " + PATCH.replace("{source}", "{fx_depth}") + " select * from ph",
)
def _(t: Inputs) -> DataFrame:
    return ge.patch_holes(t["fx_depth"], 2)


GATE = """gt as (select frame_index, sum(case when measured > 0 then 1 else 0 end) as known_pixels, avg(case when measured > 0 then predicted - measured end) as bias,
   coalesce(abs(avg(case when measured > 0 then predicted - measured end)) < 0.1, false) as accepted from {fx_depth} group by frame_index),
 wd as (select d.frame_index, d.u, d.v, d.measured, d.predicted - g.bias as predicted from {fx_depth} d join gt g on d.frame_index = g.frame_index where accepted)"""


@query("completion_bias", "frame_index:i known_pixels:i bias:d accepted:b", f"with {GATE} select * from gt")
def _(t: Inputs) -> DataFrame:
    return ge.completion_bias(t["fx_depth"])


@query("completion_gate", "frame_index:i u:i v:i measured:d predicted:d", f"with {GATE} select * from wd")
def _(t: Inputs) -> DataFrame:
    return wanted_depths(t)


@query(
    "depth_edge_mask", "frame_index:i u:i v:i gradient:d smooth:b",
    """with gr as (select f.frame_index, a.range as u, b.range as v from (select distinct frame_index from {fx_depth}) f, range(16) a, range(12) b),
    dn as (select g.*, coalesce(d.predicted, 0) as p from gr g left join {fx_depth} d on g.frame_index = d.frame_index and g.u = d.u and g.v = d.v),
    kn as (select a.range as du, b.range as dv, a.range * (2 - abs(b.range)) as kx, b.range * (2 - abs(a.range)) as ky from range(-1, 2) a, range(-1, 2) b),
    nb as (select c.frame_index, c.u, c.v, kx, ky, case when c.u + du < 0 then 1 when c.u + du > 15 then 14 else c.u + du end as nu,
      case when c.v + dv < 0 then 1 when c.v + dv > 11 then 10 else c.v + dv end as nv from gr c, kn),
    gs as (select nb.frame_index, nb.u, nb.v, sum(kx * p) as gx, sum(ky * p) as gy from nb join dn on dn.frame_index = nb.frame_index and dn.u = nu and dn.v = nv group by nb.frame_index, nb.u, nb.v)
    select frame_index, u, v, sqrt(gx * gx + gy * gy) as gradient, sqrt(gx * gx + gy * gy) < 0.1 as smooth from gs""",
)
def _(t: Inputs) -> DataFrame:
    return ge.depth_edge_mask(t["fx_depth"], 16, 12)


def backproject_text(source: str, depth: str) -> str:
    return f"""select d.*, (1 - 2 * o.qy * o.qy) * ((u - 8.0) * {depth} / 9.7) + 2 * o.qy * o.qw * {depth} + o.tx as x, (v - 6.0) * {depth} / 9.7 + o.ty as y,
     -2 * o.qy * o.qw * ((u - 8.0) * {depth} / 9.7) + (1 - 2 * o.qy * o.qy) * {depth} + o.tz as z from {source} d join {{fx_poses}} o on d.frame_index = o.frame_index where {depth} > 0 and {depth} <= 80"""


@query("backproject", "frame_index:i u:i v:i predicted:d x:d y:d z:d", backproject_text("{fx_depth}", "predicted"))
def _(t: Inputs) -> DataFrame:
    return ge.backproject(t["fx_depth"], t["fx_poses"], SMALL)


# Hole candidates of keyframes: patch minimum of the accepted, bias-free prediction.
CANDIDATES = f"""{GATE}, kd as (select * from wd where (frame_index + 1) % 5 = 0), {PATCH.replace('{source}', 'kd')},
 bp as ({backproject_text('ph', 'predicted')}), ca as (select *, frame_index::bigint * 1000 + v * 20 + u as candidate_id from bp)"""


def candidates(t: Inputs) -> DataFrame:
    keyframes = wanted_depths(t).where((F.col("frame_index") + 1) % 5 == 0)
    placed = ge.backproject(ge.patch_holes(keyframes, 2), t["fx_poses"], SMALL)
    return placed.withColumn("candidate_id", F.col("frame_index").cast("bigint") * 1000 + F.col("v") * 20 + F.col("u"))


PROXIMITY = """px as (select c.candidate_id, min((c.u - m.u) * (c.u - m.u) + (c.v - m.v) * (c.v - m.v)) as d2 from ca c join {fx_depth} m
   on m.frame_index = c.frame_index where m.measured > 0 group by c.candidate_id),
 pr as (select ca.*, case when d2 <= 2.25 then sqrt(d2) end as lidar_distance, coalesce(d2 <= 2.25, false) as near_lidar from ca left join px on ca.candidate_id = px.candidate_id)"""


def proximity(t: Inputs) -> DataFrame:
    return ge.lidar_proximity(candidates(t), t["fx_depth"], 1.5, SMALL)


@query("lidar_proximity", "candidate_id:i lidar_distance:d near_lidar:b", f"with {CANDIDATES}, {PROXIMITY} select * from pr")
def _(t: Inputs) -> DataFrame:
    return proximity(t)


RING = """kf as (select frame_index, row_number() over (order by frame_index) as no from (select distinct frame_index from {fx_depth} where (frame_index + 1) % 5 = 0) d),
 rg as (select a.frame_index, b.frame_index as support_frame, a.no - b.no as back from kf a join kf b on b.no between a.no - 4 and a.no - 1)"""


def ring(t: Inputs) -> DataFrame:
    return ge.keyframe_support_ring(t["fx_depth"].where((F.col("frame_index") + 1) % 5 == 0), 4)


@query("keyframe_support_ring", "frame_index:i support_frame:i back:i", f"with {RING} select * from rg")
def _(t: Inputs) -> DataFrame:
    return ring(t)


TOLERANCE = "greatest(0.05::double, 0.01::double * expected)"
DEPTH_SUPPORT = f"""{RING}, ow as (select candidate_id, frame_index as view_frame, u, v, predicted as expected, 4 as r2 from ca),
 mv as (select c.candidate_id, rg.support_frame as frame_index, c.x, c.y, c.z from ca c join rg on c.frame_index = rg.frame_index),
 mp as ({pixel_text(camera_text('mv'), SMALL)}),
 lk as (select * from ow union all select candidate_id, frame_index, u, v, zc, 1 from mp),
 sh as (select candidate_id, count(distinct lk.view_frame) as support from lk join {{fx_depth}} m on m.frame_index = lk.view_frame
   where m.measured > 0 and (m.u - lk.u) * (m.u - lk.u) + (m.v - lk.v) * (m.v - lk.v) <= r2 and abs(m.measured - expected) <= {TOLERANCE} group by candidate_id),
 sd as (select ca.*, coalesce(sh.support, 0) as support, coalesce(sh.support, 0) >= 2 as supported from ca left join sh on ca.candidate_id = sh.candidate_id)"""


def depth_supported(t: Inputs, source: DataFrame) -> DataFrame:
    return ge.depth_support_count(source, t["fx_depth"], t["fx_poses"], ring(t), SMALL, 1, 2, 0.05, 0.01, 2)


@query("depth_support_count", "candidate_id:i support:i supported:b", f"with {CANDIDATES}, {DEPTH_SUPPORT} select * from sd")
def _(t: Inputs) -> DataFrame:
    return depth_supported(t, candidates(t))


@query(
    "completion_counters", "frame_index:i attempts:i accepted:i rejected:i candidates:i proximity_rejected:i support_rejected:i added:i",
    f"""with {CANDIDATES}, {PROXIMITY}, {DEPTH_SUPPORT}, al as (select frame_index, 1 as attempts, accepted::int as accepted, 1 - accepted::int as rejected, 0 as candidates, 0 as proximity_rejected,
      0 as support_rejected, 0 as added from gt where (frame_index + 1) % 5 = 0
      union all select pr.frame_index, 0, 0, 0, 1, (not near_lidar)::int, (near_lidar and not supported)::int, (near_lidar and supported)::int from pr join sd on pr.candidate_id = sd.candidate_id)
    select frame_index, sum(attempts) as attempts, sum(accepted) as accepted, sum(rejected) as rejected, sum(candidates) as candidates, sum(proximity_rejected) as proximity_rejected,
      sum(support_rejected) as support_rejected, sum(added) as added from al group by rollup (frame_index)""",
)
def _(t: Inputs) -> DataFrame:
    gates = ge.completion_bias(t["fx_depth"]).where((F.col("frame_index") + 1) % 5 == 0)
    return ge.completion_counters(gates, depth_supported(t, proximity(t)))


# --- map insertion -----------------------------------------------------------------------------------

HOLES = f"""cm as (select *, zc::float as zf from ({camera_text('{fx_points}')}) c),
 hp as (select *, floor((xc::float * 40::float / zf + 32::float)::double) as u, floor((yc::float * 40::float / zf + 24::float)::double) as v from cm where zf <> 0),
 hn as (select * from (select *, row_number() over (partition by frame_index, u, v order by zf, point_idx) as rn from hp) w where rn = 1),
 hi as (select h.frame_index, h.u, h.v, h.point_idx, h.z as own_depth, h.r, h.g, h.b, h.label,
    h.u between 0 and 63 and h.v between 0 and 47 and h.z > 0 and coalesce(p.alpha, 0) < 0.99 as inserted
    from hn h left join {{fx_pixels}} p on p.frame_index = h.frame_index and p.u = h.u and p.v = h.v)"""


def inserted(t: Inputs, points: DataFrame | None = None, carry: Sequence[str] = ("r", "g", "b", "label")) -> DataFrame:
    cam = ge.world_to_camera(t["fx_points"] if points is None else points, t["fx_poses"]).withColumn("own_depth", F.col("z"))
    return ge.hole_insertion(cam, t["fx_pixels"], CAMERA, carry=carry)


@query("hole_insertion", "frame_index:i u:i v:i point_idx:i inserted:b", f"with {HOLES} select * from hi")
def _(t: Inputs) -> DataFrame:
    return inserted(t)


@query(
    "insertion_counters", "frame_index:i input_points:i nearest_z:i rejected:i inserted:i",
    f"""with {HOLES} select a.frame_index, a.n as input_points, b.n as nearest_z, b.n - b.k as rejected, b.k as inserted from (select frame_index, count(*) as n from {{fx_points}} group by frame_index) a
    join (select frame_index, count(*) as n, sum(inserted::int) as k from hi group by frame_index) b on a.frame_index = b.frame_index""",
)
def _(t: Inputs) -> DataFrame:
    return ge.insertion_counters(t["fx_points"], inserted(t))


@query(
    "seed_attributes", "frame_index:i point_idx:i log_scale:d dc_r:d dc_g:d dc_b:d opacity_logit:d rot_w:d class_strength:d",
    f"""with {HOLES} select frame_index, point_idx, ln(own_depth / 40.0) as log_scale, (r - 0.5) / {ge.SH_DC} as dc_r, (g - 0.5) / {ge.SH_DC} as dc_g, (b - 0.5) / {ge.SH_DC} as dc_b,
    ln(0.1::double / 0.9::double) as opacity_logit, 1.0 as rot_w, 4.0 * least(greatest(r, 0), 1) as class_strength from hi where inserted""",
)
def _(t: Inputs) -> DataFrame:
    seeds = inserted(t).where("inserted").withColumn("conf", F.col("r"))
    return ge.seed_attributes(seeds, CAMERA)


INCIDENCE = """iw0 as (select frame_index, u, v, rendered as d from {fx_depth}),
 iw1 as (select c.*, coalesce(l.d, 0) as ld, coalesce(r.d, 0) as rd, coalesce(t.d, 0) as td, coalesce(b.d, 0) as bd from iw0 c
   left join iw0 l on l.frame_index = c.frame_index and l.u = c.u - 1 and l.v = c.v left join iw0 r on r.frame_index = c.frame_index and r.u = c.u + 1 and r.v = c.v
   left join iw0 t on t.frame_index = c.frame_index and t.u = c.u and t.v = c.v - 1 left join iw0 b on b.frame_index = c.frame_index and b.u = c.u and b.v = c.v + 1),
 iw2 as (select *, ((u + 1 - 8.0) * rd - (u - 1 - 8.0) * ld) / 9.7 as ax, (v - 6.0) * (rd - ld) / 9.7 as ay, rd - ld as az,
   (u - 8.0) * (bd - td) / 9.7 as b_x, ((v + 1 - 6.0) * bd - (v - 1 - 6.0) * td) / 9.7 as b_y, bd - td as b_z, (u - 8.0) * d / 9.7 as px, (v - 6.0) * d / 9.7 as py from iw1),
 iw3 as (select *, ay * b_z - az * b_y as nx, az * b_x - ax * b_z as ny, ax * b_y - ay * b_x as nz from iw2),
 iw4 as (select *, sqrt(nx * nx + ny * ny + nz * nz) as nn, sqrt(px * px + py * py + d * d) as vn, abs(nx * px + ny * py + nz * d) as dt from iw3),
 iw as (select frame_index, u, v, d, u between 1 and 14 and v between 1 and 10 and d > 0 and least(ld, rd, td, bd) > 0 and nn > 1e-8 and vn > 1e-8
   and greatest(abs(ld - d), abs(rd - d), abs(td - d), abs(bd - d)) <= greatest(0.03::double, abs(d) * 0.01::double) as reliable, least(dt / greatest(nn * vn, 1e-8), 1) as cosine from iw4)"""


def incidence(t: Inputs) -> DataFrame:
    return ge.incidence_weight(t["fx_depth"].withColumn("depth", F.col("rendered")), SMALL, 2.0, 0.2, 0.03, 0.01)


@query(
    "incidence_weight", "frame_index:i u:i v:i weight:d reliable:b",
    f"with {INCIDENCE} select *, case when reliable then 0.2 + 0.8 * cosine ** 2 else 0.2 end as weight from iw",
)
def _(t: Inputs) -> DataFrame:
    return incidence(t)


@query(
    "restrict_weight", "frame_index:i u:i v:i weight:d",
    f"with {INCIDENCE} select iw.frame_index, iw.u, iw.v, case when x.ref in (1, 3) then case when reliable then 0.2 + 0.8 * cosine ** 2 else 0.2 end else 1 end as weight "
    "from iw join {fx_depth} x on iw.frame_index = x.frame_index and iw.u = x.u and iw.v = x.v",
)
def _(t: Inputs) -> DataFrame:
    return ge.restrict_weight(incidence(t), t["fx_depth"], [1, 3])


@query(
    "depth_consistency_gate", "frame_index:i point_idx:i u:i v:i valid:b",
    f"""select s.frame_index, s.point_idx, s.u, s.v, coalesce(d.rendered > 0 and abs(s.zc - d.rendered) <= greatest(0.3::double, abs(d.rendered) * 0.05::double) and d.ref between 1 and 6 and d.conf > 0, false) as valid
    from ({pixel_text('select * from (' + camera_text('{fx_points}') + ') q where zc > 0', SMALL, 'round_even({}, 0)', gate=False)}) s
    left join {{fx_depth}} d on d.frame_index = s.frame_index and d.u = s.u and d.v = s.v""",
)
def _(t: Inputs) -> DataFrame:
    cam = ge.world_to_camera(t["fx_points"], t["fx_poses"])
    surface = t["fx_depth"].select("frame_index", "u", "v", F.col("rendered").alias("depth"), "ref", "conf")
    return ge.depth_consistency_gate(cam, surface, SMALL, 7, 0.3, 0.05)


@query(
    "clamp_columns", "vec_id:i log_scale:d first:d norm2:d",
    """with n as (select vec_id, ln(0.05 + (vec_id % 7) / 10.0) as ls, feature, sqrt(list_dot_product(feature::double[], feature::double[])) as len from {fx_regions})
    select vec_id, least(ls, ln(0.3::double)) as log_scale, feature[1] * least(1, 0.5 / len) as first, (len * least(1, 0.5 / len)) ** 2 as norm2 from n""",
)
def _(t: Inputs) -> DataFrame:
    from terrascope.functions.vectors import norm2

    points = t["fx_regions"].select(
        "vec_id", F.log(0.05 + (F.col("vec_id") % 7) / 10.0).alias("log_scale"), F.col("feature").alias("latent")
    )
    clamped = ge.clamp_columns(points, 0.3, 0.5)
    return clamped.withColumn("first", F.get("latent", F.lit(0))).withColumn("norm2", norm2(F.col("latent")))


@query(
    "color_or_default", "frame_index:i point_idx:i r:i g:i b:i",
    "select frame_index, point_idx, cast(trunc(r * 100) as int) as r, case when label = 1 then 255 else label end as g, 255 as b from {fx_points}",
)
def _(t: Inputs) -> DataFrame:
    """One full channel, one with gaps, one absent."""
    points = t["fx_points"].select(
        "frame_index", "point_idx", (F.col("r") * 100).cast("int").alias("r"), F.when(F.col("label") != 1, F.col("label")).alias("g")
    )
    return ge.color_or_default(points)

"""Queries over region maps, masks, responses and training terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.functions.numeric import dequantize_u16, quantize_u16
from terrascope.operators import regions as rg
from terrascope.plans.evaluation_queries import CLASSES, LEVEL_COLUMNS, LEVELS, score_array
from terrascope.plans.inputs import Inputs
from terrascope.plans.registry import query

WIDTH, HEIGHT = 64, 48


# --- masks ------------------------------------------------------------------------------

MASK_PIXELS = f"""mp as (select m.frame_index, m.mask_id, a.range as u, b.range as v from {{fx_masks}} m, range({WIDTH}) a, range({HEIGHT}) b
   where a.range >= m.x0 and a.range < m.x0 + m.w and b.range >= m.y0 and b.range < m.y0 + m.h),
 ma as (select frame_index, mask_id, count(*) as area from mp group by frame_index, mask_id),
 mo as (select *, row_number() over (partition by frame_index order by area desc, mask_id) - 1 as mask_order from ma)"""


def mask_pixels(t: Inputs, masks: DataFrame | None = None, *carry: str) -> DataFrame:
    """Pixels of the rectangular masks, clipped to the image."""
    last_u = F.least(F.col("x0") + F.col("w"), F.lit(WIDTH)) - 1
    last_v = F.least(F.col("y0") + F.col("h"), F.lit(HEIGHT)) - 1
    return (
        (t["fx_masks"] if masks is None else masks)
        .select("frame_index", "mask_id", *carry, "x0", last_u.alias("x1"), F.explode(F.sequence("y0", last_v)).alias("v"))
        .select("frame_index", "mask_id", *carry, F.explode(F.sequence("x0", "x1")).alias("u"), "v")
    )


def mask_areas(t: Inputs) -> DataFrame:
    return mask_pixels(t).groupBy("frame_index", "mask_id").agg(F.count(F.lit(1)).alias("area"))


@query("area_rank", "frame_index:i mask_id:i area:i mask_order:i", f"with {MASK_PIXELS} select * from mo")
def _(t: Inputs) -> DataFrame:
    return rg.area_rank(mask_areas(t))


@query(
    "paint_regions", "frame_index:i u:i v:i region:i",
    f"""with {MASK_PIXELS}, f as (select distinct frame_index from mp) select f.frame_index, a.range as u, b.range as v, coalesce(max(mo.mask_order), -1) as region
    from f cross join range({WIDTH}) a cross join range({HEIGHT}) b left join mp on mp.frame_index = f.frame_index and mp.u = a.range and mp.v = b.range
    left join mo on mo.frame_index = mp.frame_index and mo.mask_id = mp.mask_id group by f.frame_index, a.range, b.range""",
)
def _(t: Inputs) -> DataFrame:
    """Masks get their order before they are spread to pixels."""
    order = rg.area_rank(mask_areas(t)).select("frame_index", "mask_id", "mask_order")
    ordered = t["fx_masks"].join(order.hint("merge"), ["frame_index", "mask_id"])
    return rg.paint_raster(mask_pixels(t, ordered, "mask_order"), WIDTH, HEIGHT)


NMS = f"""{MASK_PIXELS}, rk as (select m.frame_index, m.mask_id, m.score, ma.area, row_number() over (partition by m.frame_index order by m.score desc, m.mask_id) as rank
   from {{fx_masks}} m join ma on m.mask_id = ma.mask_id),
 pr as (select a.frame_index, a.rank as ra, b.rank as rb, a.area as aa, b.area as ab, count(*) as s from mp x join mp y on x.frame_index = y.frame_index and x.u = y.u and x.v = y.v
   join rk a on a.mask_id = x.mask_id join rk b on b.mask_id = y.mask_id where a.rank < b.rank group by a.frame_index, a.rank, b.rank, a.area, b.area),
 pm as (select *, s / (aa + ab - s) as iou, s / aa as f1, s / ab as f2, 1 - (s / aa) * (s / ab) as cs from pr),
 ef as (select frame_index, rb as rank, iou, case when f1 < 0.5 and f2 >= 0.85 then cs else 0 end as up, case when f1 < 0.5 and f2 >= 0.85 and rb = ra + 1 then cs else 0 end as lo from pm
   union all select frame_index, ra, 0, 0, case when f1 >= 0.85 and f2 < 0.5 then cs else 0 end from pm),
 ev as (select rk.*, coalesce(max(ef.iou), 0) as iou, coalesce(max(up), 0) as upper, coalesce(max(lo), 0) as lower from rk left join ef on rk.frame_index = ef.frame_index and rk.rank = ef.rank
   group by rk.frame_index, rk.mask_id, rk.score, rk.area, rk.rank),
 fl as (select *, bool_or(score > {{score}}) over (partition by frame_index) as any_s, bool_or(upper <= 0.2) over (partition by frame_index) as any_u, bool_or(lower <= 0.2) over (partition by frame_index) as any_l from ev)
 select *, iou <= 0.5 and (score > {{score}} or (not any_s and rank <= 3)) and (upper <= 0.2 or (not any_u and rank <= 3)) and (lower <= 0.2 or (not any_l and rank <= 3)) as keep from fl"""
NMS_SHAPE = "frame_index:i mask_id:i rank:i area:i iou:d upper:d lower:d keep:b"


@query("mask_nms", NMS_SHAPE, "with " + NMS.replace("{score}", "0.7"))
def _(t: Inputs) -> DataFrame:
    return rg.mask_nms(t["fx_masks"], mask_pixels(t), 0.5, 0.7, 0.8)


@query("mask_nms_fallback", NMS_SHAPE, "with " + NMS.replace("{score}", "0.989"))
def _(t: Inputs) -> DataFrame:
    """A score bound no mask of most frames reaches: their three best stay eligible."""
    return rg.mask_nms(t["fx_masks"], mask_pixels(t), 0.5, 0.989, 0.8)


@query(
    "area_stats", "level:i regions:i area_min:i area_median:d area_p90:d area_max:i median_fraction:d",
    f"""with {MASK_PIXELS} select m.level, count(*) as regions, min(area) as area_min, quantile_cont(area, 0.5) as area_median, quantile_cont(area, 0.9) as area_p90, max(area) as area_max,
    quantile_cont(area, 0.5) / {WIDTH * HEIGHT} as median_fraction from ma join {{fx_masks}} m on ma.mask_id = m.mask_id group by m.level""",
)
def _(t: Inputs) -> DataFrame:
    areas = mask_areas(t).join(t["fx_masks"].select("mask_id", "level"), "mask_id")
    return rg.area_stats(areas, WIDTH * HEIGHT, ["level"])


# --- region maps -----------------------------------------------------------------------------

@query(
    "joint_partition", "frame_index:i u:i v:i joint:i",
    f"""with l as (select frame_index, u, v, {LEVEL_COLUMNS} from {{fx_pixels}})
    select frame_index, u, v, case when greatest(r_s, r_m, r_l) < 0 then -1 else dense_rank() over (partition by frame_index, greatest(r_s, r_m, r_l) >= 0 order by r_s, r_m, r_l) - 1 end as joint from l""",
)
def _(t: Inputs) -> DataFrame:
    levels = t["fx_pixels"].select("frame_index", "u", "v", *[F.expr(e).alias(f"r_{n}") for n, e in LEVELS.items()])
    return rg.joint_partition(levels, [f"r_{n}" for n in LEVELS])


@query(
    "pixel_coverage", "frame_index:i coverage:d",
    """with f as (select frame_index, avg(case when region >= 0 then 1.0 else 0.0 end) as coverage from {fx_pixels} group by frame_index)
    select * from f union all select -1, avg(coverage) from f""",
)
def _(t: Inputs) -> DataFrame:
    return rg.pixel_coverage(t["fx_pixels"])


REMAP_ROWS = ", ".join(f"({c}, {k})" for c, labels in rg.SUPERCLASS_GROUPS.items() for k in labels)


@query(
    "label_remap", "superclass:i pixels:i",
    f"with g as (select * from (values {REMAP_ROWS}) g(c, k)) select coalesce(g.c, 0) as superclass, count(*) as pixels from {{fx_pixels}} p left join g on g.k = (p.ref * 5 + p.u) % 32 group by coalesce(g.c, 0)",
)
def _(t: Inputs) -> DataFrame:
    fine = t["fx_pixels"].withColumn("label", (F.col("ref") * 5 + F.col("u")) % 32)
    return rg.label_remap(fine, rg.SUPERCLASS_GROUPS).groupBy("superclass").agg(F.count(F.lit(1)).alias("pixels"))


@query(
    "region_boundaries", "frame_index:i u:i v:i region:i boundary:b",
    """with c as (select frame_index, u, v, region from {fx_pixels} where region >= 0)
    select c.frame_index, c.u, c.v, c.region, bool_or(coalesce(n.region <> c.region, false)) as boundary from c
    left join c n on n.frame_index = c.frame_index and ((n.v = c.v and abs(n.u - c.u) = 1) or (n.u = c.u and abs(n.v - c.v) = 1)) group by c.frame_index, c.u, c.v, c.region""",
)
def _(t: Inputs) -> DataFrame:
    return rg.region_boundaries(t["fx_pixels"])


@query(
    "focus_bounds", "frame_index:i class_id:i x0:i y0:i x1:i y1:i",
    f"""with b as (select frame_index, ref as class_id, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from {{fx_pixels}} group by frame_index, ref),
    s as (select *, least(greatest(20, u1 - u0 + 1, v1 - v0 + 1), {HEIGHT}, {WIDTH}) as span from b),
    p as (select *, least(greatest(round_even(0.5 * (u0 + u1) - span / 2, 0), 0), {WIDTH} - span) as x, least(greatest(round_even(0.5 * (v0 + v1) - span / 2, 0), 0), {HEIGHT} - span) as y from s)
    select frame_index, class_id, x as x0, y as y0, x + span as x1, y + span as y1 from p""",
)
def _(t: Inputs) -> DataFrame:
    return rg.focus_bounds(t["fx_pixels"], 20, WIDTH, HEIGHT)


# --- responses -----------------------------------------------------------------------------------

@query(
    "score_quantize", "frame_index:i u:i v:i score_u16:i restored:d",
    """with q as (select frame_index, u, v, case when alpha > 0 then round_even(least(greatest(s1 * 1.1 - 0.05, 0), 1) * 65535, 0) else 0 end as score_u16 from {fx_scored})
    select *, score_u16 / 65535.0 as restored from q""",
)
def _(t: Inputs) -> DataFrame:
    q = quantize_u16(F.col("s1") * 1.1 - 0.05, F.col("alpha") > 0)
    return t["fx_scored"].select("frame_index", "u", "v", q.alias("score_u16")).withColumn("restored", dequantize_u16(F.col("score_u16")))


@query(
    "box_smooth", "frame_index:i u:i v:i smooth:d",
    """with gr as (select f.frame_index, a.range as u, b.range as v from (select distinct frame_index from {fx_depth}) f, range(16) a, range(12) b)
    select g.frame_index, g.u, g.v, 0.5 * (coalesce(max(case when d.u = g.u and d.v = g.v then d.color end), 0) + coalesce(sum(d.color), 0) / 49) as smooth
    from gr g left join {fx_depth} d on d.frame_index = g.frame_index and d.u between g.u - 3 and g.u + 3 and d.v between g.v - 3 and g.v + 3 group by g.frame_index, g.u, g.v""",
)
def _(t: Inputs) -> DataFrame:
    """Window of 7 x 7, which fits the small raster."""
    return rg.box_smooth(t["fx_depth"].withColumn("response", F.col("color")), 16, 12, half=3)


def response_columns(t: Inputs) -> DataFrame:
    """A column of responses per class."""
    alpha = (F.col("alpha") * ((F.col("u") + F.col("v")) % 10) / 10.0).alias("alpha")
    return t["fx_scored"].select("frame_index", "u", "v", alpha, *[F.expr(f"s{c} * 0.317D * pi()").alias(f"response{c}") for c in CLASSES])


def responses(t: Inputs) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("query_id"), F.col(f"response{c}").alias("response")) for c in CLASSES])
    return response_columns(t).select("frame_index", "u", "v", "alpha", F.inline(entries))


RESPONSES = (
    "rs as (select frame_index, u, v, alpha * ((u + v) % 10) / 10.0 as alpha, c as query_id, "
    "case c when 1 then s1 when 2 then s2 when 3 then s3 when 4 then s4 when 5 then s5 else s6 end * 0.317::double * pi() as response "
    "from {fx_scored}, (select unnest([1, 2, 3, 4, 5, 6]) as c) k)"
)


@query(
    "query_response_stats", "frame_index:i query_id:i valid_pixels:i response_min:d response_mean:d response_max:d response_range:d",
    f"with {RESPONSES} select frame_index, query_id, count(*) as valid_pixels, min(response) as response_min, avg(response) as response_mean, max(response) as response_max, "
    "max(response) - min(response) as response_range from rs where alpha > 0.05 group by frame_index, query_id",
)
def _(t: Inputs) -> DataFrame:
    return rg.query_response_stats(responses(t))


@query(
    "minmax_heat", "frame_index:i query_id:i u:i v:i heat:d",
    f"""with {RESPONSES}, e as (select frame_index, query_id, min(response) as lo, max(response) as hi from rs where alpha > 0.05 group by frame_index, query_id)
    select rs.frame_index, rs.query_id, u, v, case when alpha > 0.05 then least(greatest(2 * (response - lo) / (hi - lo + 1e-9) - 1, 0), 1) else 0 end as heat
    from rs join e on rs.frame_index = e.frame_index and rs.query_id = e.query_id""",
)
def _(t: Inputs) -> DataFrame:
    return rg.minmax_heat(response_columns(t), {c: f"response{c}" for c in CLASSES})


# --- training terms ---------------------------------------------------------------------------------

WEIGHTED = """wp as (select frame_index, u, v, ref, case when ref between 1 and 6 and alpha > 0 then conf_u8 / 255.0 else 0 end as weight, alpha > 0 as static,
   s1, s2, s3, s4, s5, s6 from {fx_scored})"""


def weighted(t: Inputs) -> DataFrame:
    valid = F.col("ref").isin(CLASSES) & (F.col("alpha") > 0)
    return t["fx_scored"].select(
        "frame_index", "u", "v", "ref", F.when(valid, F.col("conf_u8") / 255.0).otherwise(0.0).alias("weight"),
        (F.col("alpha") > 0).alias("static"), F.col("alpha").cast("double").alias("alpha"), score_array("s").alias("scores"),
    )


@query(
    "class_balance_weights", "frame_index:i class_id:i histogram:d balance:d",
    f"""with {WEIGHTED}, h as (select f.frame_index, c as class_id, coalesce(sum(case when ref = c then weight end), 0) as histogram from wp f, (select unnest([1, 2, 3, 4, 5, 6]) as c) k group by f.frame_index, c),
    m as (select frame_index, sum(histogram) / greatest(sum(case when histogram > 0 then 1 else 0 end), 1) as mean from h group by frame_index)
    select h.*, case when histogram > 0 then least((mean / greatest(histogram, 1e-6)) ** 0.5, 3.0) else 0 end as balance from h join m on h.frame_index = m.frame_index""",
)
def _(t: Inputs) -> DataFrame:
    return rg.class_balance_weights(weighted(t), 0.5, 3.0, CLASSES)


GAP = " + ".join(f"abs(exp(4 * a.s{c}) / a.tot - exp(4 * b.s{c}) / b.tot)" for c in CLASSES)


@query(
    "neighbour_coherence", "frame_index:i pair_weight:d coherence_gap:d",
    f"""with {WEIGHTED}, ex as (select *, {' + '.join(f'exp(4 * s{c})' for c in CLASSES)} as tot from wp),
    pr as (select a.frame_index, least(a.weight, b.weight) as w, ({GAP}) / 6 as gap from ex a join ex b on a.frame_index = b.frame_index and a.ref = b.ref
      and ((a.u = b.u + 2 and a.v = b.v) or (a.v = b.v + 2 and a.u = b.u)))
    select frame_index, sum(w) as pair_weight, sum(w * gap) / nullif(sum(w), 0) as coherence_gap from pr group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    from terrascope.functions.vectors import softmax

    logits = F.transform("scores", lambda s: 4 * s)
    return rg.neighbour_coherence(weighted(t).withColumn("probs", softmax(logits)), 2)


@query(
    "weighted_cross_entropy", "frame_index:i weight_sum:d cross_entropy:d",
    f"""with {WEIGHTED}, c as (select frame_index, weight, ln(1 + {' + '.join(f'exp(4 * s{c})' for c in CLASSES)}) - 4 * case ref when 1 then s1 when 2 then s2 when 3 then s3 when 4 then s4 when 5 then s5 else s6 end as ce
      from wp where static and ref between 1 and 6 and weight > 0)
    select frame_index, sum(weight) as weight_sum, sum(weight * ce) / sum(weight) as cross_entropy from c group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    """Seven logits: the unknown class 0 stays at zero."""
    logits = F.concat(F.array(F.lit(0.0)), F.transform("scores", lambda s: 4 * s))
    return rg.weighted_cross_entropy(weighted(t).withColumn("logits", logits), 7)


@query(
    "masked_image_error", "frame_index:i color_l1:d depth_l1:d depth_pixels:i",
    """select frame_index, avg(case when (u + v) % 5 > 0 then abs(color - gt_color) end) as color_l1,
    avg(case when (u + v) % 5 > 0 and measured > 0 and rendered > 0 then abs(rendered - measured) end) as depth_l1,
    sum(case when (u + v) % 5 > 0 and measured > 0 and rendered > 0 then 1 else 0 end) as depth_pixels from {fx_depth} group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    pixels = t["fx_depth"].select(
        "frame_index", "color", "gt_color", F.col("rendered").alias("depth"), F.col("measured").alias("gt_depth"),
        ((F.col("u") + F.col("v")) % 5 > 0).alias("static"),
    )
    return rg.masked_image_error(pixels)

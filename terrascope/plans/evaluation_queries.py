"""Queries over the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.numeric import ratio
from terrascope.functions.single import attach
from terrascope.operators import evaluate as ev
from terrascope.operators import regions as rg
from terrascope.operators import resample as rs
from terrascope.operators.embeddings import predict_argmax, top1_margin
from terrascope.operators.frames import disjoint_scan_split
from terrascope.plans.inputs import Inputs
from terrascope.plans.registry import query

CLASSES = [1, 2, 3, 4, 5, 6]
PERIOD, OFFSET = 5, 4
REPLICATES, SEED = 2000, 3407


# --- Spark side -------------------------------------------------------------------

def splits(t: Inputs) -> DataFrame:
    return disjoint_scan_split(t["fx_alignment"], PERIOD, OFFSET)


def score_array(prefix: str) -> F.Column:
    return F.array(*[F.col(f"{prefix}{c}") for c in CLASSES])


def scored_pixels(t: Inputs) -> DataFrame:
    return t["fx_coarse"].select(
        "frame_index", "u", "v", "ref", "conf_u8", "region", "alpha",
        score_array("s").alias("scores"), score_array("c").alias("coarse"),
    )


def domain(t: Inputs) -> DataFrame:
    return ev.reference_domain(scored_pixels(t), CLASSES)


def staged(t: Inputs) -> DataFrame:
    """Domain pixels with split and the stages of the labelling chain in one row."""
    base = domain(t).join(splits(t).select("frame_index", "label_scan_index", "split"), "frame_index")
    with_oracle = ev.region_majority_oracle(base, base, CLASSES)
    covered = F.col("region") >= 0
    full = predict_argmax(with_oracle, CLASSES, covered, "scores").withColumnRenamed("pred", "_full")
    both = predict_argmax(full, CLASSES, covered, "coarse").withColumnRenamed("pred", "_compact")
    mapped = predict_argmax(both, CLASSES, F.col("alpha") > 0, "coarse").withColumnRenamed("pred", "_map")
    stages = ev.stage_structs(
        {
            "oracle": (F.col("oracle"), covered),
            "full": (F.col("_full"), covered),
            "compact": (F.col("_compact"), covered),
            "map": (F.col("_map"), F.col("alpha") > 0),
        }
    )
    return mapped.withColumn("stages", stages).drop("oracle", "_full", "_compact", "_map")


def stage_long(t: Inputs) -> DataFrame:
    return ev.stage_rows(staged(t).select("frame_index", "label_scan_index", "u", "v", "split", "ref", "stages"))


def evaluated(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("train", "heldout"))


def stage_metrics(t: Inputs) -> DataFrame:
    keys = ["split", "stage", "stage_order"]
    return ev.scalar_metrics(ev.class_tallies(evaluated(stage_long(t)), CLASSES, keys), CLASSES, keys)


def oracle_region_counts(t: Inputs) -> DataFrame:
    return ev.region_counts(domain(t), CLASSES)


# --- check side -----------------------------------------------------------------

SPLITS = """select frame_index, label_scan_index, case when frame_index % 5 = 4 then 'train'
  when label_scan_index < 0 then 'unmatched'
  when label_scan_index in (select label_scan_index from {fx_alignment} where frame_index % 5 = 4 and label_scan_index >= 0)
  then 'shared_scan_excluded' else 'heldout' end as split from {fx_alignment}"""
DOMAIN = "select * from {fx_coarse} where ref between 1 and 6 and conf_u8 / 255.0 >= 0.35"


def argmax_text(prefix: str) -> str:
    best = f"greatest({', '.join(f'{prefix}{c}' for c in CLASSES)})"
    return "case " + " ".join(f"when {prefix}{c} = {best} then {c}" for c in CLASSES) + " end"


def argmax_last_text(prefix: str) -> str:
    best = f"greatest({', '.join(f'{prefix}{c}' for c in CLASSES)})"
    return "case " + " ".join(f"when {prefix}{c} = {best} then {c}" for c in reversed(CLASSES)) + " end"


COUNTS = f"""dom as ({DOMAIN}),
cnt as (select frame_index, region, ref, count(*) as n from dom group by frame_index, region, ref),
maj as (select frame_index, region, ref as oracle, n as majority from (
  select *, row_number() over (partition by frame_index, region order by n desc, ref) as rn from cnt where region >= 0) r where rn = 1),
rc as (select c.*, coalesce(m.oracle, 0) as oracle, coalesce(m.majority, 0) as majority
  from cnt c left join maj m on c.frame_index = m.frame_index and c.region = m.region)"""

STAGES = f"""{COUNTS}, spl as ({SPLITS}),
px as (select d.*, s.split, s.label_scan_index, coalesce(m.oracle, 0) as oracle from dom d join spl s on d.frame_index = s.frame_index
  left join maj m on d.frame_index = m.frame_index and d.region = m.region),
st as (
  select frame_index, label_scan_index, u, v, split, ref, 'oracle' as stage, 0 as stage_order, oracle as pred, region >= 0 as valid from px
  union all select frame_index, label_scan_index, u, v, split, ref, 'full', 1, case when region >= 0 then {argmax_text('s')} else 0 end, region >= 0 from px
  union all select frame_index, label_scan_index, u, v, split, ref, 'compact', 2, case when region >= 0 then {argmax_text('c')} else 0 end, region >= 0 from px
  union all select frame_index, label_scan_index, u, v, split, ref, 'map', 3, case when alpha > 0 then {argmax_text('c')} else 0 end, alpha > 0 from px)"""


def metrics_text(source: str, keys: str, union_rule: bool = False) -> str:
    """Metrics of rows (keys, ref, pred, n, valid) by a long per-class table."""
    on = " and ".join(f"a.{k.strip()} is not distinct from b.{k.strip()}" for k in keys.split(","))
    iou = "hit / nullif(sup + outp - hit, 0)" if union_rule else "case when sup > 0 then hit / nullif(sup + outp - hit, 0) end"
    return f"""select a.*, b.macro_iou, b.balanced_accuracy from (
  select {keys}, sum(n) as reference_pixels, sum(case when ref = pred then n else 0 end) / nullif(sum(n), 0) as pixel_accuracy,
    1.0 - sum(case when pred between 1 and 6 then 0 else n end) / nullif(sum(n), 0) as prediction_coverage,
    sum(case when valid then n else 0 end) / nullif(sum(n), 0) as stage_valid_coverage from ({source}) r group by {keys}) a
 join (select {keys}, avg({iou}) as macro_iou, avg(hit / nullif(sup, 0)) as balanced_accuracy, sum(sup * {iou}) / nullif(sum(sup), 0) as fw_iou from (
   select {keys}, c, cast(sum(case when ref = c then n else 0 end) as double) as sup, cast(sum(case when pred = c then n else 0 end) as double) as outp,
     cast(sum(case when ref = c and pred = c then n else 0 end) as double) as hit
   from ({source}) r2, (select unnest([1, 2, 3, 4, 5, 6]) as c) cls group by {keys}, c) t group by {keys}) b on {on}"""


STAGE_METRICS = f"""with {STAGES}, m as ({metrics_text("select *, 1 as n from st where split in ('train', 'heldout')", "split, stage, stage_order")}) """

METRIC_SHAPE = "reference_pixels:i pixel_accuracy:d balanced_accuracy:d macro_iou:d prediction_coverage:d stage_valid_coverage:d"


# --- domains and regions -------------------------------------------------------------

@query("reference_domain", "frame_index:i u:i v:i ref:i conf_u8:i", DOMAIN)
def _(t: Inputs) -> DataFrame:
    return ev.reference_domain(t["fx_pixels"], CLASSES)


REGION_SCORES = ", ".join(f"((region * 31 + frame_index * 7 + {c} * 13) % 101) / cast(100 as double) as s{c}" for c in CLASSES)


def region_score_table(t: Inputs) -> DataFrame:
    regions = t["fx_pixels"].where(F.col("region") >= 0).select("frame_index", "region").distinct()
    scores = [F.expr(f"((region * 31 + frame_index * 7 + {c} * 13) % 101) / cast(100 as double)") for c in CLASSES]
    return regions.select("frame_index", "region", F.array(*scores).alias("scores"))


@query(
    "region_to_pixel",
    "frame_index:i u:i v:i covered:b " + " ".join(f"s{c}:d" for c in CLASSES),
    "select frame_index, u, v, region >= 0 as covered, "
    + ", ".join(
        f"case when region >= 0 then ((region * 31 + frame_index * 7 + {c} * 13) % 101) / cast(100 as double) else 0 end as s{c}"
        for c in CLASSES
    )
    + " from {fx_pixels}",
)
def _(t: Inputs) -> DataFrame:
    looked = ev.region_to_pixel(t["fx_pixels"], region_score_table(t), len(CLASSES))
    return looked.select("*", *[F.get("scores", F.lit(i)).alias(f"s{c}") for i, c in enumerate(CLASSES)])


@query(
    "region_majority_oracle",
    "frame_index:i u:i v:i region:i oracle:i",
    f"with {COUNTS} select p.frame_index, p.u, p.v, p.region, coalesce(m.oracle, 0) as oracle from {{fx_pixels}} p "
    "left join maj m on p.frame_index = m.frame_index and p.region = m.region",
)
def _(t: Inputs) -> DataFrame:
    pixels = t["fx_pixels"]
    return ev.region_majority_oracle(pixels, ev.reference_domain(pixels, CLASSES), CLASSES)


@query(
    "region_purity",
    "frame_index:i assigned_regions:i mean_region_purity:d pixel_weighted_region_purity:d",
    f"""with {COUNTS} select frame_index, count(*) as assigned_regions, avg(majority / pixels) as mean_region_purity,
    sum(majority) / sum(pixels) as pixel_weighted_region_purity from (
      select frame_index, region, max(n) as majority, sum(n) as pixels from cnt where region >= 0 group by frame_index, region) r group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    return ev.region_purity(oracle_region_counts(t))


PER_CLASS = """select {keys} c as class_id, coalesce(sum(case when ref = c then n end), 0) as reference_pixels,
 coalesce(sum(case when ref = c and region >= 0 then n end), 0) as covered_pixels,
 coalesce(sum(case when ref = c and oracle = c then n end), 0) as correct_pixels
 from {source}, (select unnest([1, 2, 3, 4, 5, 6]) as c) cls group by {keys} c"""


@query(
    "oracle_per_class",
    "frame_index:i class_id:i reference_pixels:i covered_pixels:i correct_pixels:i coverage:d recall:d covered_accuracy:d",
    f"""with {COUNTS}, g as ({PER_CLASS.format(keys='frame_index,', source='rc')})
    select *, covered_pixels / nullif(reference_pixels, 0) as coverage, correct_pixels / nullif(reference_pixels, 0) as recall,
    correct_pixels / nullif(covered_pixels, 0) as covered_accuracy from g""",
)
def _(t: Inputs) -> DataFrame:
    return ev.oracle_per_class(oracle_region_counts(t), CLASSES)


@query(
    "oracle_by_split",
    "split:s class_id:i reference_pixels:i covered_pixels:i correct_pixels:i assigned_regions:i uncovered_pixels:i covered_wrong_pixels:i "
    "coverage:d covered_accuracy:d recall:d uncovered_fraction:d covered_wrong_fraction:d",
    f"""with {COUNTS}, spl as ({SPLITS}),
    tagged as (select r.*, s.split from rc r join spl s on r.frame_index = s.frame_index union all select r.*, 'all' from rc r),
    asg as (select split, oracle as class_id, count(*) as assigned_regions from (select distinct split, frame_index, region, oracle from tagged where region >= 0) d group by split, oracle),
    g as ({PER_CLASS.format(keys='split,', source='tagged')})
    select g.*, coalesce(a.assigned_regions, 0) as assigned_regions, reference_pixels - covered_pixels as uncovered_pixels,
      covered_pixels - correct_pixels as covered_wrong_pixels, covered_pixels / nullif(reference_pixels, 0) as coverage,
      correct_pixels / nullif(covered_pixels, 0) as covered_accuracy, correct_pixels / nullif(reference_pixels, 0) as recall,
      (reference_pixels - covered_pixels) / nullif(reference_pixels, 0) as uncovered_fraction,
      (covered_pixels - correct_pixels) / nullif(reference_pixels, 0) as covered_wrong_fraction
    from g left join asg a on g.split = a.split and g.class_id = a.class_id""",
)
def _(t: Inputs) -> DataFrame:
    return ev.oracle_by_split(oracle_region_counts(t), splits(t), CLASSES)


# --- confusion and metrics -----------------------------------------------------------

@query(
    "confusion_matrix",
    "stage:s ref:i pred:i n:i",
    f"""with {STAGES} select g.stage, g.ref, g.pred, count(s.ref) as n from (
      select distinct s.stage, r.ref, p.pred from st s, (select unnest([1, 2, 3, 4, 5, 6]) as ref) r, (select unnest([0, 1, 2, 3, 4, 5, 6]) as pred) p) g
      left join st s on g.stage = s.stage and g.ref = s.ref and g.pred = s.pred group by g.stage, g.ref, g.pred""",
)
def _(t: Inputs) -> DataFrame:
    return ev.confusion_matrix(stage_long(t), CLASSES, ["stage"])


@query("scalar_metrics", f"split:s stage:s {METRIC_SHAPE}", STAGE_METRICS + "select * from m")
def _(t: Inputs) -> DataFrame:
    return stage_metrics(t)


AP = """apr as (select {keys}, c as class_id, cast(case c when 1 then s1 when 2 then s2 when 3 then s3 when 4 then s4 when 5 then s5 else s6 end as float) as score,
    case when ref = c then 1 else 0 end as hit from {source}, (select unnest([1, 2, 3, 4, 5, 6]) as c) cls),
  aps as (select {keys}, class_id, score, sum(hit) as pos, count(*) as seen from apr group by {keys}, class_id, score),
  apc as (select *, sum(pos) over (partition by {keys}, class_id order by score desc) as cp, sum(seen) over (partition by {keys}, class_id order by score desc) as cs from aps),
  ap as (select {keys}, class_id, sum(pos * (cp / cs)) / nullif(sum(pos), 0) as ap, sum(pos) as positives from apc group by {keys}, class_id)"""


def ap_pixels(t: Inputs) -> DataFrame:
    """Domain pixels with split; uncovered pixels keep zero scores."""
    zeros = F.array(*[F.lit(0.0)] * len(CLASSES))
    scored = domain(t).withColumn("scores", F.when(F.col("region") >= 0, F.col("scores")).otherwise(zeros))
    return scored.join(splits(t).select("frame_index", "split"), "frame_index")


AP_SOURCE = (
    "(select split, ref, " + ", ".join(f"case when region >= 0 then s{c} else 0 end as s{c}" for c in CLASSES)
    + f" from ({DOMAIN}) d join ({SPLITS}) s on d.frame_index = s.frame_index) z"
)
AP_TEXT = f"with {AP.format(keys='split', source=AP_SOURCE)}"
AP_TEXT = AP_TEXT.replace("{{", "{").replace("}}", "}")


@query("average_precision", "split:s class_id:i ap:d positives:i", AP_TEXT + " select * from ap")
def _(t: Inputs) -> DataFrame:
    return ev.average_precision(ap_pixels(t), CLASSES, ["split"])


@query(
    "macro_ap", "split:s macro_ap:d macro_ap_class_count:i",
    AP_TEXT + " select split, avg(ap) as macro_ap, count(ap) as macro_ap_class_count from ap group by split",
)
def _(t: Inputs) -> DataFrame:
    return ev.macro_ap(ev.average_precision(ap_pixels(t), CLASSES, ["split"]), ["split"])


@query(
    "class_report",
    "split:s class_id:i reference_pixels:i predicted_pixels:i true_positive:i false_positive:i false_negative:i precision:d recall:d iou:d ap:d",
    f"""{AP_TEXT}, {STAGES}, g as (select split, c as class_id, sum(case when ref = c then 1 else 0 end) as reference_pixels,
      sum(case when pred = c then 1 else 0 end) as predicted_pixels, sum(case when ref = c and pred = c then 1 else 0 end) as true_positive
      from st, (select unnest([1, 2, 3, 4, 5, 6]) as c) cls where stage = 'full' group by split, c)
    select g.*, predicted_pixels - true_positive as false_positive, reference_pixels - true_positive as false_negative,
      true_positive / nullif(predicted_pixels, 0) as precision, true_positive / nullif(reference_pixels, 0) as recall,
      case when reference_pixels > 0 then true_positive / nullif(reference_pixels + predicted_pixels - true_positive, 0) end as iou, ap.ap
    from g left join ap on g.split = ap.split and g.class_id = ap.class_id""",
)
def _(t: Inputs) -> DataFrame:
    pixels = predict_argmax(ap_pixels(t), CLASSES, F.col("region") >= 0)
    tallies = ev.class_tallies(pixels, CLASSES, ["split"])
    ap = ev.average_precision(pixels, CLASSES, ["split"])
    return ev.class_report(tallies, CLASSES, ["split"], ap)


ALPHA = f"(select d.*, s.split from ({DOMAIN}) d join ({SPLITS}) s on d.frame_index = s.frame_index where split in ('train', 'heldout'))"
ALPHA_METRICS = metrics_text(
    f"select split, ref, {argmax_last_text('s')} as pred, 1 as n, true as valid from {ALPHA} z where alpha > 0", "split", True
)


@query(
    "metric_report_alpha",
    "split:s reference_pixels:i known_before_alpha:i alpha_valid_coverage:d pixel_accuracy:d balanced_accuracy:d macro_iou:d frequency_weighted_iou:d",
    f"""with m as ({ALPHA_METRICS.replace('b.balanced_accuracy', 'b.balanced_accuracy, b.fw_iou')}),
    k as (select split, count(*) as known_before_alpha from {ALPHA} z group by split)
    select m.*, k.known_before_alpha, m.reference_pixels / k.known_before_alpha as alpha_valid_coverage, fw_iou as frequency_weighted_iou
    from m join k on m.split = k.split""",
)
def _(t: Inputs) -> DataFrame:
    known = evaluated(domain(t).join(splits(t).select("frame_index", "split"), "frame_index"))
    before = known.groupBy("split").agg(F.count(F.lit(1)).alias("known_before_alpha"))
    ids = F.array(*[F.lit(c) for c in CLASSES])
    seen = top1_margin(known.where(F.col("alpha") > 0)).withColumn("pred", F.get(ids, F.col("top")))
    return ev.metric_report_alpha(ev.class_tallies(seen, CLASSES, ["split"]), CLASSES, before, ["split"])


@query(
    "per_frame_metrics",
    f"frame_index:i split:s stage:s {METRIC_SHAPE}",
    f"with {STAGES} " + metrics_text("select *, 1 as n from st where split in ('train', 'heldout')", "frame_index, split, stage"),
)
def _(t: Inputs) -> DataFrame:
    keys = ["frame_index", "split", "stage"]
    return ev.scalar_metrics(ev.class_tallies(evaluated(stage_long(t)), CLASSES, keys), CLASSES, keys)


@query(
    "domain_masks",
    f"domain:s stage:s {METRIC_SHAPE}",
    f"with {STAGES}, com as (select frame_index, u, v, bool_and(valid) as allv from st group by frame_index, u, v), "
    "tagged as (select st.*, 'full_reference' as domain from st union all select st.*, 'common_valid' from st join com "
    "on st.frame_index = com.frame_index and st.u = com.u and st.v = com.v where com.allv) "
    + metrics_text("select *, 1 as n from tagged where split = 'heldout'", "domain, stage"),
)
def _(t: Inputs) -> DataFrame:
    held = staged(t).where(F.col("split") == "heldout").select("ref", "stages")
    rows = ev.stage_rows(ev.domain_masks(held))
    return ev.scalar_metrics(ev.class_tallies(rows, CLASSES, ["domain", "stage"]), CLASSES, ["domain", "stage"])


@query(
    "stage_union", "frame_index:i u:i v:i split:s ref:i stage:s stage_order:i pred:i valid:b",
    f"with {STAGES} select * from st",
)
def _(t: Inputs) -> DataFrame:
    return stage_long(t)


@query(
    "stage_drops", "split:s stage:s macro_iou:d drop_from_previous:d retained:d",
    STAGE_METRICS + """select split, stage, macro_iou, lag(macro_iou) over (partition by split order by stage_order) - macro_iou as drop_from_previous,
    macro_iou / nullif(lag(macro_iou) over (partition by split order by stage_order), 0) as retained from m""",
)
def _(t: Inputs) -> DataFrame:
    return ev.stage_drops(stage_metrics(t), ["split"])


# --- resampling -------------------------------------------------------------------------

def boot_text(group_cte: str) -> str:
    sums = ", ".join(
        f"sum(case when ref = {c} then 1 else 0 end) as sup_{c}, sum(case when pred = {c} then 1 else 0 end) as out_{c}, "
        f"sum(case when ref = {c} and pred = {c} then 1 else 0 end) as hit_{c}" for c in CLASSES
    )
    pooled = ", ".join(f"sum({p}_{c}) as {p}_{c}" for c in CLASSES for p in ("sup", "out", "hit"))
    ious = ", ".join(f"case when sup_{c} > 0 then hit_{c} / nullif(sup_{c} + out_{c} - hit_{c}, 0) end" for c in CLASSES)
    recalls = ", ".join(f"hit_{c} / nullif(sup_{c}, 0)" for c in CLASSES)
    hits = " + ".join(f"hit_{c}" for c in CLASSES)
    return f"""with {STAGES}, grp as ({group_cte}),
  tal as (select grp.group_id, stage, stage_order, count(*) as total, sum(case when valid then 1 else 0 end) as valid_pixels, {sums}
    from st join grp on st.frame_index = grp.frame_index where split = 'heldout' group by grp.group_id, stage, stage_order),
  num as (select group_id, row_number() over (order by group_id) - 1 as position from (select distinct group_id from tal) d),
  x0 as (select r.range as replicate, n.position as slot, (select count(*) from num) as g,
    (r.range * 1000003 + n.position * 7919 + {SEED * 104729}) % 2147483647 as x from range({REPLICATES}) r, num n),
  x1 as (select *, (x * 48271) % 2147483647 as h from x0),
  x2 as (select *, (h * h) % 2147483647 as h2 from x1),
  pick as (select replicate, ((h2 * 69621 + x) % 2147483647) % g as position from x2),
  pool as (select replicate, stage, stage_order, sum(total) as total, sum(valid_pixels) as valid_pixels, {pooled}
    from pick join num on pick.position = num.position join tal on num.group_id = tal.group_id group by replicate, stage, stage_order),
  met as (select replicate, stage, stage_order, list_avg([{ious}]) as macro_iou, list_avg([{recalls}]) as balanced_accuracy,
    ({hits}) / total as pixel_accuracy, valid_pixels / total as stage_valid_coverage from pool),
  lev as (select stage, unnest(['macro_iou', 'balanced_accuracy', 'pixel_accuracy', 'stage_valid_coverage']) as metric,
      unnest([macro_iou, balanced_accuracy, pixel_accuracy, stage_valid_coverage]) as value from met
    union all select b.stage, 'macro_iou_drop', a.macro_iou - b.macro_iou from met a join met b on a.replicate = b.replicate and a.stage_order + 1 = b.stage_order)
  select stage, metric, avg(value) as bootstrap_mean, quantile_cont(value, 0.025) as ci95_low, quantile_cont(value, 0.975) as ci95_high from lev group by stage, metric"""


BOOT_SHAPE = "stage:s metric:s bootstrap_mean:d ci95_low:d ci95_high:d"


def bootstrap(t: Inputs, groups: DataFrame) -> DataFrame:
    held = stage_long(t).where(F.col("split") == "heldout").drop("label_scan_index")
    keys = ["group_id", "stage", "stage_order"]
    tallies = ev.class_tallies(held.join(groups, "frame_index"), CLASSES, keys)
    return rs.bootstrap_intervals(rs.bootstrap_replicates(tallies, CLASSES, REPLICATES, SEED))


@query("group_bootstrap_ci", BOOT_SHAPE, boot_text("select frame_index, label_scan_index as group_id from spl"))
def _(t: Inputs) -> DataFrame:
    return bootstrap(t, splits(t).select("frame_index", F.col("label_scan_index").alias("group_id")))


@query(
    "block_bootstrap_ci", BOOT_SHAPE,
    boot_text("select frame_index, cast(floor((row_number() over (order by frame_index) - 1) / 3) as bigint) as group_id from spl where split = 'heldout'"),
)
def _(t: Inputs) -> DataFrame:
    return bootstrap(t, rs.frame_blocks(splits(t).where(F.col("split") == "heldout"), 3))


# --- calibration --------------------------------------------------------------------------

SCORE_GRID, MARGIN_GRID = [k / 10 for k in range(10)], [0.0, 0.01, 0.02, 0.05, 0.1, 0.2]
SORTED = "list_sort([s1, s2, s3, s4, s5, s6])"
CAL_ROWS = f"""select split, ref, {argmax_last_text('s')} as top, {SORTED}[6] as top_score, {SORTED}[6] - {SORTED}[5] as margin from {ALPHA} z where alpha > 0"""
CELLS = f"""cal as ({CAL_ROWS}), cells as (select st.s as score_threshold, mt.m as margin_threshold from
  (select unnest({SCORE_GRID}::double[]) as s) st, (select unnest({MARGIN_GRID}::double[]) as m) mt),
  cellrows as (select score_threshold, margin_threshold, ref, case when top_score >= score_threshold and margin >= margin_threshold then top else 0 end as pred, 1 as n, true as valid
    from cal, cells where split = 'train'),
  grid as ({metrics_text("select * from cellrows", "score_threshold, margin_threshold", True)})"""


def calibration_pixels(t: Inputs) -> DataFrame:
    known = evaluated(domain(t).join(splits(t).select("frame_index", "split"), "frame_index"))
    ids = F.array(*[F.lit(c) for c in CLASSES])
    return top1_margin(known.where(F.col("alpha") > 0)).withColumn("top_class", F.get(ids, F.col("top")))


@query(
    "calibrate_unknown",
    "score_threshold:d margin_threshold:d train_macro_iou:d train_pixel_accuracy:d known_prediction_coverage:d",
    f"with {CELLS} select score_threshold, margin_threshold, macro_iou as train_macro_iou, pixel_accuracy as train_pixel_accuracy, prediction_coverage as known_prediction_coverage from grid",
)
def _(t: Inputs) -> DataFrame:
    train = calibration_pixels(t).where(F.col("split") == "train")
    return ev.calibrate_unknown(train, CLASSES, SCORE_GRID, MARGIN_GRID)


@query(
    "apply_calibration",
    "split:s score_threshold:d margin_threshold:d macro_iou:d pixel_accuracy:d known_prediction_coverage:d",
    f"""with {CELLS}, best as (select * from grid order by macro_iou desc, score_threshold, margin_threshold limit 1),
    app as (select c.split, c.ref, case when c.top_score >= b.score_threshold and c.margin >= b.margin_threshold then c.top else 0 end as pred, 1 as n, true as valid from cal c, best b),
    am as ({metrics_text('select * from app', 'split', True)})
    select am.split, b.score_threshold, b.margin_threshold, am.macro_iou, am.pixel_accuracy, am.prediction_coverage as known_prediction_coverage from am, best b""",
)
def _(t: Inputs) -> DataFrame:
    rows = calibration_pixels(t)
    cells = ev.calibrate_unknown(rows.where(F.col("split") == "train"), CLASSES, SCORE_GRID, MARGIN_GRID)
    best = ev.best_thresholds(cells).select("score_threshold", "margin_threshold")
    chosen = attach(rows, best)
    sure = (F.col("top_score") >= F.col("score_threshold")) & (F.col("margin") >= F.col("margin_threshold"))
    keys = ["split", "score_threshold", "margin_threshold"]
    applied = chosen.withColumn("pred", F.when(sure, F.col("top_class")).otherwise(F.lit(0)))
    report = ev.class_report(ev.class_tallies(applied, CLASSES, keys), CLASSES, keys, union_rule=True)
    iou = report.groupBy(*keys).agg(F.avg("iou").alias("macro_iou"))
    plain = ev.scalar_metrics(ev.class_tallies(applied, CLASSES, keys), CLASSES, keys)
    return plain.drop("macro_iou").withColumnRenamed("prediction_coverage", "known_prediction_coverage").join(iou, keys)


# --- levels --------------------------------------------------------------------------------

LEVELS = {
    "s": "case when (u + v) % 11 = 0 then -1 else cast(floor(u / 8) + 8 * floor(v / 8) as int) end",
    "m": "case when (u + 2 * v) % 7 = 0 then -1 else cast(floor(u / 16) + 4 * floor(v / 16) as int) end",
    "l": "case when (3 * u + v) % 5 = 0 then -1 else cast(floor(u / 32) + 2 * floor(v / 24) as int) end",
}
LEVEL_COLUMNS = ", ".join(f"{text} as r_{name}" for name, text in LEVELS.items())


def level_pixels(t: Inputs) -> DataFrame:
    pixels = ev.reference_domain(t["fx_pixels"], CLASSES)
    return pixels.select("frame_index", "u", "v", "ref", *[F.expr(text).alias(f"r_{n}") for n, text in LEVELS.items()])


def level_majority_text(name: str) -> str:
    return f"""mj_{name} as (select frame_index, r_{name}, ref as o_{name} from (select frame_index, r_{name}, ref,
      row_number() over (partition by frame_index, r_{name} order by count(*) desc, ref) as rn from lv where r_{name} >= 0 group by frame_index, r_{name}, ref) z where rn = 1)"""


@query(
    "any_level_recoverability",
    "class_id:i reference_pixels:i covered_pixels:i correct_pixels:i any_level_coverage:d any_level_recall:d",
    f"with lv as (select *, {LEVEL_COLUMNS} from ({DOMAIN}) d), {', '.join(level_majority_text(n) for n in LEVELS)}, "
    + "al as (select lv.ref, " + " or ".join(f"lv.r_{n} >= 0" for n in LEVELS) + " as cov, "
    + " or ".join(f"coalesce(o_{n} = lv.ref, false)" for n in LEVELS) + " as ok from lv "
    + " ".join(f"left join mj_{n} on lv.frame_index = mj_{n}.frame_index and lv.r_{n} = mj_{n}.r_{n}" for n in LEVELS)
    + """) select c as class_id, count(al.ref) as reference_pixels, coalesce(sum(case when cov then 1 else 0 end) filter (where al.ref is not null), 0) as covered_pixels,
      coalesce(sum(case when ok then 1 else 0 end) filter (where al.ref is not null), 0) as correct_pixels,
      sum(case when cov then 1 else 0 end) / nullif(count(al.ref), 0) as any_level_coverage, sum(case when ok then 1 else 0 end) / nullif(count(al.ref), 0) as any_level_recall
      from (select unnest([1, 2, 3, 4, 5, 6]) as c) cls left join al on al.ref = c group by c""",
)
def _(t: Inputs) -> DataFrame:
    pixels = level_pixels(t)
    for name in LEVELS:
        source = pixels.withColumn("region", F.col(f"r_{name}"))
        pixels = ev.region_majority_oracle(source, source, CLASSES).withColumnRenamed("oracle", f"o_{name}").drop("region")
    levels = F.array(*[F.struct(F.col(f"o_{n}").alias("pred"), (F.col(f"r_{n}") >= 0).alias("valid")) for n in LEVELS])
    return ev.any_level_recoverability(pixels.withColumn("levels", levels), CLASSES)


@query(
    "level_oracles",
    f"level:s {METRIC_SHAPE}",
    f"""with lv0 as (select *, {LEVEL_COLUMNS} from ({DOMAIN}) d),
    lv1 as (select *, case when greatest(r_s, r_m, r_l) < 0 then -1 else dense_rank() over (partition by frame_index, greatest(r_s, r_m, r_l) >= 0 order by r_s, r_m, r_l) - 1 end as r_joint from lv0),
    lx as (select frame_index, ref, 's' as level, r_s as region from lv1 union all select frame_index, ref, 'm', r_m from lv1
      union all select frame_index, ref, 'l', r_l from lv1 union all select frame_index, ref, 'joint', r_joint from lv1),
    lc as (select level, frame_index, region, ref, count(*) as n from lx group by level, frame_index, region, ref),
    lo as (select *, case when region < 0 then 0 else first_value(ref) over (partition by level, frame_index, region order by n desc, ref) end as pred, region >= 0 as valid from lc) """
    + metrics_text("select * from lo", "level"),
)
def _(t: Inputs) -> DataFrame:
    names = [f"r_{n}" for n in LEVELS]
    joint = rg.joint_partition(level_pixels(t), names)
    entries = F.array(
        *[F.struct(F.lit(n).alias("level"), F.col(f"r_{n}").alias("region")) for n in LEVELS],
        F.struct(F.lit("joint").alias("level"), F.col("joint").alias("region")),
    )
    long = joint.select("frame_index", "ref", F.inline(entries))
    counts = ev.region_counts(long, CLASSES, ["level", "frame_index"])
    rows = counts.select("level", "ref", F.col("oracle").alias("pred"), "n", (F.col("region") >= 0).alias("valid"))
    return ev.scalar_metrics(ev.class_tallies(rows, CLASSES, ["level"]), CLASSES, ["level"])


@query(
    "area_order_audit",
    "median_s:d median_m:d median_l:d ordered_frames:i frames_tested:i ordered_fraction:d",
    """with a as (select frame_index, level, quantile_cont(w * h, 0.5) as area_median from {fx_masks} group by frame_index, level),
    w as (select frame_index, max(case when level = 0 then area_median end) as s, max(case when level = 1 then area_median end) as m,
      max(case when level = 2 then area_median end) as l from a group by frame_index)
    select quantile_cont(s, 0.5) as median_s, quantile_cont(m, 0.5) as median_m, quantile_cont(l, 0.5) as median_l,
      sum(case when s <= m and m <= l then 1 else 0 end) as ordered_frames, count(*) as frames_tested,
      sum(case when s <= m and m <= l then 1 else 0 end) / count(*) as ordered_fraction from w""",
)
def _(t: Inputs) -> DataFrame:
    areas = t["fx_masks"].select("frame_index", "level", (F.col("w") * F.col("h")).alias("area"))
    stats = rg.area_stats(areas, 64 * 48, ["frame_index", "level"])
    named = stats.withColumn("level", F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("l")), F.col("level") + 1))
    return ev.area_order_audit(named.select("frame_index", "level", "area_median"))


@query(
    "region_top1_accuracy",
    "eligible_regions:i region_top1_accuracy:d pixel_weighted_accuracy:d",
    f"""with rp as (select *, {REGION_SCORES} from {{fx_pixels}} where region >= 0),
    rr as (select frame_index, region, count(*) as pixels, sum(case when ref between 1 and 6 then 1 else 0 end) as labelled, min({argmax_text('s')}) as cls from rp group by frame_index, region),
    tg as (select frame_index, region, ref as target from (select frame_index, region, ref, row_number() over (partition by frame_index, region order by count(*) desc, ref) as rn
      from rp where ref between 1 and 6 group by frame_index, region, ref) z where rn = 1)
    select count(*) as eligible_regions, sum(case when cls = target then 1 else 0 end) / count(*) as region_top1_accuracy,
      sum(case when cls = target then labelled else 0 end) / sum(labelled) as pixel_weighted_accuracy
    from rr join tg on rr.frame_index = tg.frame_index and rr.region = tg.region where labelled > 0 and labelled >= 0.5 * pixels""",
)
def _(t: Inputs) -> DataFrame:
    classes = predict_argmax(region_score_table(t), CLASSES, F.lit(True)).withColumnRenamed("pred", "region_class")
    return ev.region_top1_accuracy(t["fx_pixels"], classes, CLASSES)


@query(
    "oracle_subset",
    f"{METRIC_SHAPE} frames:i",
    f"with {STAGES}, m as ({metrics_text('select 1 as one, *, 1 as n from st where split = ' + chr(39) + 'heldout' + chr(39) + ' and stage = ' + chr(39) + 'oracle' + chr(39), 'one')}) "
    "select m.*, (select count(distinct frame_index) from st where split = 'heldout') as frames from m",
)
def _(t: Inputs) -> DataFrame:
    """The held-out frames as the listed subset: a semi-join on counts, not on pixels."""
    listed = splits(t).where(F.col("split") == "heldout").select("frame_index")
    counts = oracle_region_counts(t).join(listed, "frame_index", "left_semi")
    rows = counts.select("frame_index", "ref", F.col("oracle").alias("pred"), "n", (F.col("region") >= 0).alias("valid"))
    metrics = ev.scalar_metrics(ev.class_tallies(rows, CLASSES), CLASSES)
    frames = rows.agg(F.count_distinct("frame_index").alias("frames"))
    return attach(metrics, frames)


# --- images, tables, checks -------------------------------------------------------------------

@query(
    "psnr_depth_l1",
    "split:s views:i psnr:d depth_l1:d depth_pixels:i",
    f"""with spl as ({SPLITS}), vw as (select s.split, d.frame_index, avg((color - gt_color) * (color - gt_color)) as mse,
      sum(case when measured > 0 and rendered > 0 then abs(rendered - measured) end) as gap, count(case when measured > 0 and rendered > 0 then 1 end) as dp
      from {{fx_depth}} d join spl s on d.frame_index = s.frame_index group by s.split, d.frame_index)
    select split, count(*) as views, avg(-10.0 * log10(mse)) as psnr, sum(gap) / nullif(sum(dp), 0) as depth_l1, sum(dp) as depth_pixels from vw group by split""",
)
def _(t: Inputs) -> DataFrame:
    pixels = t["fx_depth"].select(
        "frame_index", "color", "gt_color", F.col("rendered").alias("depth"), F.col("measured").alias("gt_depth")
    )
    return ev.psnr_depth_l1(pixels.join(splits(t).select("frame_index", "split"), "frame_index"))


@query(
    "preflight_checks",
    "name:s passed:b detail:s hard:b all_passed:b",
    """with f as (select distinct frame_index from {fx_pixels}), a as (select distinct frame_index from {fx_alignment}), g as (select distinct frame_index from {fx_regions}),
    c as (select 'archives_complete' as name, (select count(*) from f where frame_index not in (select frame_index from g)) as n, 'missing=' as lab
      union all select 'report_frame_set_exact', (select count(*) from f where frame_index not in (select frame_index from a)) + (select count(*) from a where frame_index not in (select frame_index from f)), 'differing='),
    k as (select name, n = 0 as passed, lab || n as detail, true as hard from c
      union all select 'feature_dimension', min(len(feature)) = 64 and max(len(feature)) = 64, 'dimension=' || max(len(feature)), true from {fx_regions}
      union all select 'legacy_warning', false, 'recorded only', false)
    select *, (select bool_and(passed) from k where hard) as all_passed from k""",
)
def _(t: Inputs) -> DataFrame:
    frames = t["fx_pixels"].select("frame_index").distinct()
    size = t["fx_regions"].agg(F.min(F.size("feature")).alias("lo"), F.max(F.size("feature")).alias("hi"))
    facts = size.select(
        F.lit("feature_dimension").alias("name"), ((F.col("lo") == 64) & (F.col("hi") == 64)).alias("passed"),
        F.concat(F.lit("dimension="), F.col("hi").cast("string")).alias("detail"), F.lit(True).alias("hard"),
    ).unionByName(
        t.spark.range(1).select(
            F.lit("legacy_warning").alias("name"), F.lit(False).alias("passed"), F.lit("recorded only").alias("detail"), F.lit(False).alias("hard")
        )
    )
    return ev.preflight_checks(
        frames, t["fx_regions"].select("frame_index").distinct(), t["fx_alignment"].select("frame_index").distinct(), facts
    )


@query(
    "table_diff",
    "field:s max_abs:d changed:b first_min:d first_max:d first_std:d second_min:d second_max:d second_std:d",
    """with d as (select p_size / cast(50 as double) as a, (p_size + case when p_brand = 'Brand#2' then 1 else 0 end) / cast(50 as double) as b, p_retailprice as x,
      p_retailprice + case when p_type = 'ECONOMY' then 0.25 else 0 end as y, p_size as z from {part})
    select 'semantic_prob_0' as field, max(abs(a - b)) as max_abs, max(abs(a - b)) <> 0 as changed, min(a) as first_min, max(a) as first_max, stddev_pop(a) as first_std,
      min(b) as second_min, max(b) as second_max, stddev_pop(b) as second_std from d
    union all select 'price', max(abs(x - y)), max(abs(x - y)) <> 0, null, null, null, null, null, null from d
    union all select 'size', max(abs(z - z)), max(abs(z - z)) <> 0, null, null, null, null, null, null from d""",
)
def _(t: Inputs) -> DataFrame:
    part = t["part"]
    first = part.select("p_partkey", (F.col("p_size") / 50.0).alias("semantic_prob_0"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    second = part.select(
        "p_partkey",
        ((F.col("p_size") + F.when(F.col("p_brand") == "Brand#2", 1).otherwise(0)) / 50.0).alias("semantic_prob_0"),
        (F.col("p_retailprice") + F.when(F.col("p_type") == "ECONOMY", 0.25).otherwise(0.0)).alias("price"),
        F.col("p_size").alias("size"), F.lit(1.0).alias("debug_only"),
    )
    return ev.table_diff(first, second, "p_partkey", ["debug_"])


GATE_ROWS = ", ".join(f"('{g}', '{m}', '{c}', {b}::double)" for g, m, c, b in ev.GATES)


@query(
    "gate_decisions",
    "gate:s metric:s comparison:s bound:d value:d passed:b",
    STAGE_METRICS + f""", h as (select * from m where split = 'heldout'),
    val as (select 's0_macro_iou' as metric, (select macro_iou from h where stage = 'oracle') as value
      union all select 's1_over_s0', (select macro_iou from h where stage = 'full') / (select macro_iou from h where stage = 'oracle')
      union all select 's2_over_s1', (select macro_iou from h where stage = 'compact') / (select macro_iou from h where stage = 'full')
      union all select 's3_over_s2', (select macro_iou from h where stage = 'map') / (select macro_iou from h where stage = 'compact')
      union all select 'coverage_drop', (select stage_valid_coverage from h where stage = 'compact') - (select stage_valid_coverage from h where stage = 'map'))
    select g.*, val.value, case when comparison = 'ge' then value >= bound else value <= bound end as passed
    from (values {GATE_ROWS}) g(gate, metric, comparison, bound) left join val on g.metric = val.metric""",
)
def _(t: Inputs) -> DataFrame:
    held = stage_metrics(t).where(F.col("split") == "heldout")
    # One row per stage: a window over the four stages of one split.
    order = Window.partitionBy("split").orderBy("stage_order")
    chained = held.select(
        "stage_order", "macro_iou",
        ratio(F.col("macro_iou"), F.lag("macro_iou").over(order)).alias("kept"),
        (F.lag("stage_valid_coverage").over(order) - F.col("stage_valid_coverage")).alias("lost"),
    )
    named = F.element_at(F.array(F.lit("s0_macro_iou"), F.lit("s1_over_s0"), F.lit("s2_over_s1"), F.lit("s3_over_s2")), F.col("stage_order") + 1)
    values = chained.select(named.alias("metric"), F.when(F.col("stage_order") == 0, F.col("macro_iou")).otherwise(F.col("kept")).alias("value"))
    drop = chained.where(F.col("stage_order") == 3).select(F.lit("coverage_drop").alias("metric"), F.col("lost").alias("value"))
    return ev.gate_decisions(values.unionByName(drop))


# --- per-pixel diagnostics -------------------------------------------------------------------

@query(
    "error_code",
    "frame_index:i reference_pixels:i covered_pixels:i correct_pixels:i coverage:d covered_accuracy:d",
    f"""with {COUNTS}, e as (select p.frame_index, p.ref between 1 and 6 and p.conf_u8 / 255.0 >= 0.35 as rv, p.region >= 0 as cov, coalesce(m.oracle, 0) = p.ref as ok
      from {{fx_pixels}} p left join maj m on p.frame_index = m.frame_index and p.region = m.region)
    select frame_index, sum(case when rv then 1 else 0 end) as reference_pixels, sum(case when rv and cov then 1 else 0 end) as covered_pixels,
      sum(case when rv and cov and ok then 1 else 0 end) as correct_pixels,
      coalesce(sum(case when rv and cov then 1 else 0 end) / nullif(sum(case when rv then 1 else 0 end), 0), 0) as coverage,
      coalesce(sum(case when rv and cov and ok then 1 else 0 end) / nullif(sum(case when rv and cov then 1 else 0 end), 0), 0) as covered_accuracy from e group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    pixels = t["fx_pixels"]
    oracle = ev.region_majority_oracle(pixels, ev.reference_domain(pixels, CLASSES), CLASSES)
    valid = ev.is_class(F.col("ref"), CLASSES) & (F.col("conf_u8") / 255.0 >= 0.35)
    return rg.error_code_summary(rg.error_code(oracle.withColumn("reference_valid", valid)))


@query(
    "excluded_label_counts",
    "class_id:i pixels:i",
    "select c as class_id, (select count(*) from {fx_pixels} where ref = c and conf_u8 / 255.0 >= 0.35) as pixels from (select unnest([0, 7]) as c) x",
)
def _(t: Inputs) -> DataFrame:
    return rg.excluded_label_counts(t["fx_pixels"], [0, 7])



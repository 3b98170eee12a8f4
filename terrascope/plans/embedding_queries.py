"""Queries over region vectors, relevancy, compression and codebooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.functions.single import attach
from terrascope.functions.vectors import l2_normalize, norm2
from terrascope.operators import embeddings as em
from terrascope.plans.evaluation_queries import SPLITS, splits
from terrascope.plans.frame_queries import BASIS, BASIS_SQL, COMPONENTS, MEAN, MEAN_SQL, WIDTH
from terrascope.plans.inputs import Inputs
from terrascope.plans.registry import query


def bank(t: Inputs) -> em.PromptBank:
    return em.load_prompts(t["fx_prompts"])


def labels_of(b: em.PromptBank) -> list[int]:
    """One number per positive prompt: ten times the class plus the query."""
    return [c * 10 + q for c, q in zip(b.query_class, b.query_ids)]


# --- check texts ----------------------------------------------------------------------

ITEMS = f"""it as (select vec_id, frame_index, region, label, generate_subscripts(feature, 1) - 1 as i, unnest(feature)::double as v from {{fx_regions}}),
 pq as (select class_id, query_id, generate_subscripts(feature, 1) - 1 as i, unnest(feature)::double as v from {{fx_prompts}}),
 pn as (select class_id, query_id, sqrt(sum(v * v)) as len from pq group by class_id, query_id),
 pp as (select pq.class_id, pq.query_id, pq.class_id * 10 + pq.query_id as qid, i, v / len as v from pq join pn on pq.class_id = pn.class_id and pq.query_id = pn.query_id),
 ba as {BASIS_SQL}, mn as {MEAN_SQL},
 lt as (select vec_id, k, sum((it.v - mn.m) * ba.b) as z from it join mn on it.i = mn.i join ba on it.i = ba.i group by vec_id, k),
 r0 as (select vec_id, ba.i, any_value(mn.m) + sum(z * ba.b) as y from lt join ba on lt.k = ba.k join mn on mn.i = ba.i group by vec_id, ba.i),
 r1 as (select vec_id, sqrt(sum(y * y)) as len from r0 group by vec_id),
 rc as (select r0.vec_id, i, y / greatest(len, 1e-12) as v from r0 join r1 on r0.vec_id = r1.vec_id)"""

SCORES = ITEMS + """, fd as (select vec_id, class_id, query_id, qid, sum(it.v * pp.v) as s from it join pp on it.i = pp.i group by vec_id, class_id, query_id, qid),
 fn as (select vec_id, max(s) as worst from fd where class_id < 0 group by vec_id),
 fr as (select fd.vec_id, class_id, qid, s, 1 / (1 + exp(least(greatest(-10 * (s - worst), -80), 80))) as r from fd join fn on fd.vec_id = fn.vec_id where class_id >= 0),
 cd as (select vec_id, class_id, query_id, qid, sum(rc.v * pp.v) as s from rc join pp on rc.i = pp.i group by vec_id, class_id, query_id, qid),
 cn as (select vec_id, max(s) as worst from cd where class_id < 0 group by vec_id),
 cr as (select cd.vec_id, class_id, qid, s, 1 / (1 + exp(least(greatest(-10 * (s - worst), -80), 80))) as r from cd join cn on cd.vec_id = cn.vec_id where class_id >= 0),
 fs as (select vec_id, class_id, max(r) as score, avg(r) as mean_score from fr group by vec_id, class_id),
 ft as (select *, row_number() over (partition by vec_id order by score desc, class_id desc) as rn from fs)"""


# --- vectors ------------------------------------------------------------------------------

@query(
    "l2_normalize", "vec_id:i norm2:d first:d last:d",
    f"with {ITEMS}, n as (select vec_id, sqrt(sum(v * v)) as len from it group by vec_id) select it.vec_id, sum((v / len) * (v / len)) as norm2, "
    "sum(case when i = 0 then v / len end) as first, sum(case when i = 63 then v / len end) as last from it join n on it.vec_id = n.vec_id group by it.vec_id",
)
def _(t: Inputs) -> DataFrame:
    unit = t["fx_regions"].select("vec_id", l2_normalize(F.col("feature")).alias("u"))
    return unit.select("vec_id", norm2(F.col("u")).alias("norm2"), F.get("u", F.lit(0)).alias("first"), F.get("u", F.lit(WIDTH - 1)).alias("last"))


@query(
    "pca_project", "vec_id:i mean_dot:d k:i basis_dot:d",
    f"with {ITEMS}, b as (select vec_id, k, sum(v * b) as basis_dot from it join ba on it.i = ba.i group by vec_id, k), m as (select vec_id, sum(v * m) as mean_dot from it join mn on it.i = mn.i group by vec_id) "
    "select b.vec_id, mean_dot, k, basis_dot from b join m on b.vec_id = m.vec_id",
)
def _(t: Inputs) -> DataFrame:
    projected = em.pca_project(t["fx_regions"].select("vec_id", "feature"), MEAN, BASIS)
    return projected.select("vec_id", "mean_dot", F.posexplode("basis_dot").alias("k0", "basis_dot")).withColumn("k", F.col("k0") + 1)


@query("pca_reconstruct", "vec_id:i i:i v:d", f"with {ITEMS} select * from rc")
def _(t: Inputs) -> DataFrame:
    rebuilt = em.pca_reconstruct(t["fx_regions"].select("vec_id", "feature"), MEAN, BASIS)
    return rebuilt.select("vec_id", F.posexplode("reconstructed").alias("i", "v"))


COSINES = ITEMS + """, qb as (select qid, k, sum(pp.v * b) as bd from pp join ba on pp.i = ba.i where class_id >= 0 group by qid, k),
 qm as (select qid, sum(pp.v * m) as md from pp join mn on pp.i = mn.i where class_id >= 0 group by qid),
 bm as (select k, sum(m * b) as bmean from mn join ba on mn.i = ba.i group by k),
 zz as (select vec_id, (select sum(m * m) from mn) + 2 * sum(z * bmean) + sum(z * z) as sq from lt join bm on lt.k = bm.k group by vec_id),
 co as (select lt.vec_id, qb.qid, (any_value(md) + sum(z * bd)) / sqrt(greatest(any_value(sq), 1e-12)) as cosine from lt join qb on lt.k = qb.k join qm on qm.qid = qb.qid join zz on zz.vec_id = lt.vec_id group by lt.vec_id, qb.qid)"""


def cosines(t: Inputs, b: em.PromptBank) -> DataFrame:
    latent = em.latents(t["fx_regions"].select("vec_id", "feature"), MEAN, BASIS)
    return em.latent_cosine(latent, MEAN, BASIS, b.positives)


def exploded(df: DataFrame, labels: list[int], source: str, value: str) -> DataFrame:
    ids = F.array(*[F.lit(q) for q in labels])
    return df.select("vec_id", F.posexplode(source).alias("_p", value)).select("vec_id", F.get(ids, F.col("_p")).alias("qid"), value)


@query("latent_cosine", "vec_id:i qid:i cosine:d", f"with {COSINES} select * from co")
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    return exploded(cosines(t, b), labels_of(b), "cosines", "cosine")


@query(
    "assign_query_class", "vec_id:i qid:i similarity:d margin:d",
    f"""with {COSINES}, w as (select *, row_number() over (partition by vec_id order by cosine desc, qid desc) as rn from co)
    select a.vec_id, a.qid, a.cosine as similarity, a.cosine - b.cosine as margin from w a join w b on a.vec_id = b.vec_id where a.rn = 1 and b.rn = 2""",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    return em.assign_query_class(cosines(t, b).select("vec_id", "cosines"), labels_of(b)).withColumnRenamed("query_id", "qid")


@query(
    "query_class_counts", "qid:i points:i",
    f"""with {COSINES}, w as (select *, row_number() over (partition by vec_id order by cosine desc, qid desc) as rn from co)
    select q.qid, (select count(*) from w where rn = 1 and w.qid = q.qid) as points from (select distinct qid from co) q""",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    assigned = em.assign_query_class(cosines(t, b).select("vec_id", "cosines"), labels_of(b))
    return em.query_class_counts(assigned, labels_of(b)).withColumnRenamed("query_id", "qid")


# --- relevancy ----------------------------------------------------------------------------------

@query("relevancy", "vec_id:i qid:i r:d", f"with {SCORES} select * from fr")
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    return exploded(em.relevancy(t["fx_regions"].select("vec_id", "feature"), b), labels_of(b), "relevancy", "r")


@query("prompt_aggregate", "vec_id:i class_id:i score:d mean_score:d", f"with {SCORES} select * from fs")
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    rel = em.relevancy(t["fx_regions"].select("vec_id", "feature"), b)
    both = em.prompt_aggregate(em.prompt_aggregate(rel, b, "max", output="a"), b, "mean", output="m")
    ids = F.array(*[F.lit(c) for c in b.class_ids])
    zipped = F.arrays_zip(ids.alias("class_id"), F.col("a"), F.col("m"))
    return both.select("vec_id", F.inline(zipped)).toDF("vec_id", "class_id", "score", "mean_score")


@query(
    "query_raster_scores", "frame_index:i u:i v:i c1:d c2:d c3:d",
    """select frame_index, u, v, greatest(q1, q2) / 65535.0 as c1, greatest(q3, q4) / 65535.0 as c2, greatest(q5, q6) / 65535.0 as c3 from (select frame_index, u, v, round_even(s1 * 65535, 0) as q1, round_even(s2 * 65535, 0) as q2,
      round_even(s3 * 65535, 0) as q3, round_even(s4 * 65535, 0) as q4, round_even(s5 * 65535, 0) as q5, round_even(s6 * 65535, 0) as q6 from {fx_scored}) x""",
)
def _(t: Inputs) -> DataFrame:
    """One row per query raster and pixel, 16-bit scores."""
    rows = F.array(*[F.struct(F.lit(c).alias("query_id"), F.rint(F.col(f"s{c}") * 65535).cast("int").alias("score_u16")) for c in range(1, 7)])
    rasters = t["fx_scored"].select("frame_index", "u", "v", F.inline(rows))
    scored = em.query_raster_scores(rasters, {1: [1, 2], 2: [3, 4], 3: [5, 6]})
    return scored.withColumn("c1", F.get("scores", F.lit(0))).withColumn("c2", F.get("scores", F.lit(1))).withColumn("c3", F.get("scores", F.lit(2)))


def scored_items(t: Inputs, b: em.PromptBank) -> DataFrame:
    return em.class_scores(t["fx_regions"].select("vec_id", "feature"), b)


@query(
    "top1_margin", "vec_id:i class_id:i top_score:d margin:d",
    f"with {SCORES} select a.vec_id, a.class_id, a.score as top_score, a.score - b.score as margin from ft a join ft b on a.vec_id = b.vec_id where a.rn = 1 and b.rn = 2",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    ids = F.array(*[F.lit(c) for c in b.class_ids])
    return em.top1_margin(scored_items(t, b)).withColumn("class_id", F.get(ids, F.col("top")))


@query(
    "predict_unknown", "vec_id:i pred:i",
    f"with {SCORES} select a.vec_id, case when a.score >= 0.51 and a.score - b.score >= 0.02 then a.class_id else 0 end as pred from ft a join ft b on a.vec_id = b.vec_id where a.rn = 1 and b.rn = 2",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    return em.predict_unknown(scored_items(t, b), b.class_ids, 0.51, 0.02)


@query(
    "predict_argmax", "vec_id:i pred:i",
    f"with {SCORES}, g as (select *, row_number() over (partition by vec_id order by score desc, class_id) as rk from fs) select vec_id, case when vec_id % 7 = 0 then 0 else class_id end as pred from g where rk = 1",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    return em.predict_argmax(scored_items(t, b), b.class_ids, F.col("vec_id") % 7 != 0)


# --- preservation -----------------------------------------------------------------------------------

def both_scores(t: Inputs, b: em.PromptBank, how: str) -> DataFrame:
    """Full and compressed scores of every prompt: similarity or relevancy."""
    rebuilt = em.pca_reconstruct(t["fx_regions"].select("vec_id", "frame_index", "region", "feature"), MEAN, BASIS)
    if how == "relevancy":
        return em.relevancy(em.relevancy(rebuilt, b, "feature", "full"), b, "reconstructed", "compact")
    from terrascope.functions.vectors import times_matrix

    return rebuilt.withColumn("full", times_matrix(F.col("feature"), b.positives.T)).withColumn(
        "compact", times_matrix(F.col("reconstructed"), b.positives.T)
    )


PRESERVE = SCORES + """, fo as (select *, row_number() over (partition by vec_id order by s desc, qid desc) as rn from fr), cp as (select *, row_number() over (partition by vec_id order by s desc, qid desc) as rn from cr),
 tp as (select a.vec_id, a.s - b.s as margin, a.qid = c.qid as same, a.qid as full_qid, c.qid as compact_qid from fo a join fo b on a.vec_id = b.vec_id join cp c on a.vec_id = c.vec_id where a.rn = 1 and b.rn = 2 and c.rn = 1),
 er as (select avg(abs(a.s - c.s)) as mae, max(abs(a.s - c.s)) as mx from fr a join cr c on a.vec_id = c.vec_id and a.qid = c.qid)"""


@query(
    "query_preservation", "regions:i top1_agreement:d agreement_margin_01:d agreement_margin_02:d full_margin_mean:d score_mae:d score_max_abs:d",
    f"""with {PRESERVE} select count(*) as regions, avg(same::int) as top1_agreement, avg(case when margin >= 0.01 then same::int end) as agreement_margin_01,
    avg(case when margin >= 0.02 then same::int end) as agreement_margin_02, avg(margin) as full_margin_mean, (select mae from er) as score_mae, (select mx from er) as score_max_abs from tp""",
)
def _(t: Inputs) -> DataFrame:
    return em.query_preservation(both_scores(t, bank(t), "similarity"))


@query(
    "query_preservation_counts", "qid:i full_count:i compact_count:i",
    f"with {PRESERVE} select q.qid, (select count(*) from tp where full_qid = q.qid) as full_count, (select count(*) from tp where compact_qid = q.qid) as compact_count from (select distinct qid from fr) q",
)
def _(t: Inputs) -> DataFrame:
    b = bank(t)
    both = both_scores(t, b, "similarity")
    full = em.top1_counts(both, labels_of(b), "full").withColumnRenamed("points", "full_count")
    compact = em.top1_counts(both, labels_of(b), "compact").withColumnRenamed("points", "compact_count")
    return full.join(compact, "query_id").withColumnRenamed("query_id", "qid")


PAIRS = SCORES + """, pa as (select a.vec_id, i.frame_index, i.region, a.qid, a.r as f, c.r as c from fr a join cr c on a.vec_id = c.vec_id and a.qid = c.qid join {fx_regions} i on i.vec_id = a.vec_id)"""


def audit_pairs(t: Inputs) -> DataFrame:
    b = bank(t)
    return em.paired_scores(both_scores(t, b, "relevancy"), labels_of(b), ["frame_index", "region"]).withColumn(
        "query_id", F.col("query_id").cast("bigint")
    )


@query(
    "relevancy_audit", "query_id:i mae:d max_error:d pearson:d relevancy_mean:d relevancy_p95:d p95_error:d",
    f"""with {PAIRS} select qid as query_id, avg(abs(f - c)) as mae, max(abs(f - c)) as max_error,
      case when stddev_pop(f) * stddev_pop(c) > 1e-12 then corr(f, c) end as pearson, avg(f) as relevancy_mean, quantile_cont(f, 0.95) as relevancy_p95, null as p95_error from pa group by qid
    union all select -1, avg(abs(f - c)), max(abs(f - c)), null, null, null, quantile_cont(abs(f - c), 0.95) from pa""",
)
def _(t: Inputs) -> DataFrame:
    return em.relevancy_audit(audit_pairs(t))


@query(
    "topset_jaccard", "query_id:i frame_mean_jaccard:d frames:i",
    f"""with {PAIRS}, w as (select *, count(*) over (partition by frame_index, qid) as n, row_number() over (partition by frame_index, qid order by f desc, region) as rf,
      row_number() over (partition by frame_index, qid order by c desc, region) as rk from pa),
    j as (select frame_index, qid, sum((rf <= greatest(1, ceil(0.1 * n)) and rk <= greatest(1, ceil(0.1 * n)))::int) / sum((rf <= greatest(1, ceil(0.1 * n)) or rk <= greatest(1, ceil(0.1 * n)))::int) as jac from w group by frame_index, qid)
    select qid as query_id, avg(jac) as frame_mean_jaccard, count(*) as frames from j group by qid""",
)
def _(t: Inputs) -> DataFrame:
    return em.topset_jaccard(audit_pairs(t))


# --- scores of masks -------------------------------------------------------------------------------------

@query("region_confidence", "vec_id:i confidence:d", "select vec_id, sqrt(least(greatest(predicted_iou * stability, 0), 1)) as confidence from {fx_regions}")
def _(t: Inputs) -> DataFrame:
    return em.region_confidence(t["fx_regions"])


@query("mask_score", "vec_id:i score:d", "select vec_id, predicted_iou * stability as score from {fx_regions}")
def _(t: Inputs) -> DataFrame:
    return em.mask_score(t["fx_regions"])


@query(
    "feature_qc", "rows:i dimension_min:i dimension_max:i norm_min:d norm_max:d all_finite:b",
    f"with {ITEMS}, n as (select vec_id, count(*) as d, sqrt(sum(v * v)) as len, bool_and(isfinite(v)) as fin from it group by vec_id) "
    "select count(*) as rows, min(d) as dimension_min, max(d) as dimension_max, min(len) as norm_min, max(len) as norm_max, bool_and(fin) as all_finite from n",
)
def _(t: Inputs) -> DataFrame:
    return em.feature_qc(t["fx_regions"])


# --- rendered language -------------------------------------------------------------------------------------

RENDERED = ITEMS + f""", bd as (select vec_id, k, sum(v * b) as basis_dot from it join ba on it.i = ba.i group by vec_id, k), md as (select vec_id, sum(v * m) as mean_dot from it join mn on it.i = mn.i group by vec_id),
 bm as (select k, sum(m * b) as bmean from mn join ba on mn.i = ba.i group by k),
 rg as (select vec_id, frame_index, region, sqrt(least(greatest(predicted_iou * stability, 0), 1)) as confidence from {{fx_regions}}),
 rp as (select p.frame_index, p.u, p.v, rg.vec_id, rg.confidence, p.alpha * ((p.u + p.v) % 10) / 10.0 > 0.05 as visible from {{fx_pixels}} p join rg on rg.frame_index = p.frame_index and rg.region = p.region
   where p.region >= 0 and p.conf_u8 > 20),
 rz as (select rp.*, lt.k, lt.z + 0.01 * ((u + v + lt.k) % 7 - 3) as z, basis_dot, bmean from rp join lt on lt.vec_id = rp.vec_id join bd on bd.vec_id = rp.vec_id and bd.k = lt.k join bm on bm.k = lt.k),
 rx as (select frame_index, u, v, any_value(rz.vec_id) as vec_id, any_value(confidence) as confidence, any_value(visible) as visible, sum(z * basis_dot) as dt, 2 * sum(z * bmean) + sum(z * z) as sq,
   avg(abs(z - (basis_dot - bmean))) as gap from rz group by frame_index, u, v),
 ry as (select rx.*, least(greatest((mean_dot + dt) / sqrt(greatest((select sum(m * m) from mn) + sq, 1e-12)), -1), 1) as cosine from rx join md on md.vec_id = rx.vec_id)"""


def supervised(t: Inputs) -> DataFrame:
    """Rendered latents near their region's own, and the region targets."""
    regions = em.region_confidence(t["fx_regions"])
    targets = em.latents(em.pca_project(regions, MEAN, BASIS), MEAN, BASIS).select(
        "frame_index", (F.col("region") + 1).alias("region_id"), "basis_dot", "mean_dot", "confidence", F.col("latent").alias("_z")
    )
    pixels = t["fx_pixels"].select(
        "frame_index", "u", "v", (F.col("region") + 1).alias("region_id"), (F.col("conf_u8") > 20).alias("static"),
        (F.col("alpha") * ((F.col("u") + F.col("v")) % 10) / 10.0).alias("alpha"),
    )
    wobble = F.transform("_z", lambda z, k: z + 0.01 * ((F.col("u") + F.col("v") + k + 1) % 7 - 3))
    return em.supervised_pixels(pixels, targets).withColumn("latent", wobble).drop("_z")


@query(
    "weighted_language_cosine", "split:s language_cosine:d valid_pixels:i target_pixels:i target_views:i",
    f"""with {RENDERED}, s as ({SPLITS}) select s.split, sum(case when visible then cosine * confidence end) / sum(case when visible then confidence end) as language_cosine,
    sum(visible::int) as valid_pixels, count(*) as target_pixels, count(distinct ry.frame_index) as target_views from ry join s on s.frame_index = ry.frame_index group by s.split""",
)
def _(t: Inputs) -> DataFrame:
    return em.weighted_language_cosine(supervised(t), splits(t), MEAN, BASIS)


@query(
    "coefficient_l1", "frame_index:i coefficient_l1:d",
    f"with {RENDERED} select frame_index, sum(gap * confidence) / sum(confidence) as coefficient_l1 from ry where visible group by frame_index",
)
def _(t: Inputs) -> DataFrame:
    return em.coefficient_l1(supervised(t), MEAN, BASIS)


# --- covariance ------------------------------------------------------------------------------------------------

@query(
    "covariance_fit", "i:i j:i cov:d mean_i:d",
    f"""with {ITEMS}, mu as (select i, avg(v) as m from it group by i), n as (select count(distinct vec_id) as n from it)
    select a.i, b.i as j, sum((a.v - ma.m) * (b.v - mb.m)) / (any_value(n.n) - 1) as cov, any_value(ma.m) as mean_i from it a join it b on a.vec_id = b.vec_id
    join mu ma on ma.i = a.i join mu mb on mb.i = b.i, n group by a.i, b.i""",
)
def _(t: Inputs) -> DataFrame:
    return em.covariance(em.weighted_moments(t["fx_regions"]))


@query(
    "weighted_covariance_fit", "i:i j:i cov:d mean_i:d",
    f"""with {ITEMS}, tx as (select class_id, query_id, i, v from pp), nn as (select (select count(distinct vec_id) from it) as a, (select count(*) from pn) as b),
    al as (select 'r' || vec_id as id, i, v, 1.0 as w from it union all select 't' || class_id || '-' || query_id, i, v, 0.5 * a / b from tx, nn),
    ws as (select sum(w) as wsum from al where i = 0), mu as (select i, sum(w * v) / any_value(wsum) as m from al, ws group by i)
    select a.i, b.i as j, sum(a.w * (a.v - ma.m) * (b.v - mb.m)) / greatest(any_value(wsum) - 1, 1) as cov, any_value(ma.m) as mean_i from al a join al b on a.id = b.id
    join mu ma on ma.i = a.i join mu mb on mb.i = b.i, ws group by a.i, b.i""",
)
def _(t: Inputs) -> DataFrame:
    text = t["fx_prompts"].select(l2_normalize(F.col("feature")).alias("feature"))
    scene = t["fx_regions"].select(F.transform("feature", lambda x: x.cast("double")).alias("feature"))
    both = em.two_population_weights(scene, text, 0.5)
    return em.covariance(em.weighted_moments(both, F.col("weight")))


@query("basis_explained", "dimension:i explained:d leading_share:d")
def _(t: Inputs) -> DataFrame:
    """Eigen step on the small covariance; vectors have free signs, so shares are reported."""
    cov = em.covariance(em.weighted_moments(t["fx_regions"]))
    basis = em.fit_basis(cov, COMPONENTS)
    values = np.clip(basis.eigenvalues, 0, None)
    row = [(COMPONENTS, float(basis.explained), float(values[0] / values.sum()))]
    return t.spark.createDataFrame(row, "dimension int, explained double, leading_share double")


# --- codebooks ---------------------------------------------------------------------------------------------------

@query("codebook_kmeans", "center:i members:i similarity_mean:d")
def _(t: Inputs) -> DataFrame:
    """Fit on the earlier frames, assign every region."""
    items = t["fx_regions"].select("vec_id", "frame_index", "feature")
    last = items.agg(F.max("frame_index").alias("last"))
    held = attach(items, last)
    fit = held.where(F.col("frame_index") <= F.col("last") - 1).select("vec_id", "feature")
    centers = em.codebook_kmeans(fit, "vec_id", 64, 25, 3407)
    assigned = em.assign_center(items.withColumn("feature", l2_normalize(F.col("feature"))), centers)
    return assigned.groupBy("center").agg(F.count(F.lit(1)).alias("members"), F.avg("similarity").alias("similarity_mean"))


@query(
    "codebook_quality", "regions:i top1_cosine_mean:d top1_cosine_p05:d",
    f"with {SCORES}, n as (select vec_id, sqrt(sum(v * v)) as len from it group by vec_id), b as (select fr.vec_id, max(s) / any_value(len) as c from fr join n on fr.vec_id = n.vec_id group by fr.vec_id) "
    "select count(*) as regions, avg(c) as top1_cosine_mean, quantile_cont(c, 0.05) as top1_cosine_p05 from b",
)
def _(t: Inputs) -> DataFrame:
    """The prompt vectors serve as a fixed codebook."""
    return em.codebook_quality(t["fx_regions"], bank(t).positives)


@query("codebook_topk_ls", "regions:i topk_cosine_mean:d topk_cosine_p05:d")
def _(t: Inputs) -> DataFrame:
    return em.codebook_topk_ls(t["fx_regions"], bank(t).positives)

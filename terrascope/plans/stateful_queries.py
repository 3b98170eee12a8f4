"""Queries over point state and streams; streams run over the same rows as their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.operators import geometry as ge
from terrascope.operators import stateful as sf
from terrascope.plans.frame_queries import NEAREST, TOLERANCE_S
from terrascope.plans.geometry_queries import CAMERA, DYNAMIC, HOLES, dynamic_projected, inserted, numbered, supported
from terrascope.plans.inputs import DERIVED, Inputs
from terrascope.plans.registry import query
from terrascope.session import cut_lineage
from terrascope.streaming import operators as so
from terrascope.streaming.run import Closing, file_stream, run_append, run_update, saved, stream_session

CLASS_COUNT, ALPHA, SCALE, SWITCH = 6, 0.3, 4.0, 1.505

OBS = f"""ob as (select point_id, target, conf, row_number() over (partition by point_id order by ts, seq) as n, count(*) over (partition by point_id) as total
  from {{fx_observations}} where target between 1 and {CLASS_COUNT - 1} and conf > 0)"""


def event_streams(t: Inputs, *names: str) -> list[DataFrame]:
    """Derived tables over the event stream, all in one session of their own."""
    session = stream_session(t.spark)
    events = file_stream(session, t.folder, "events", t["events"].schema)
    return [session.sql(DERIVED[n], events=events) if n in DERIVED else events for n in names]


def delay(t: Inputs) -> str:
    """How late rows may come. One file is one batch, in which nothing is late; several may come in any order.

    A source that delivers in time order states its own delay, an hour say.
    """
    files, longest = t["events"].agg(
        F.count_distinct(F.col("_metadata.file_path")), F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")
    ).first()
    return f"{(longest or 0) + 2} seconds" if files > 1 else "2 seconds"


def last_events(t: Inputs) -> DataFrame:
    """One event of every type, far beyond the others and with ids below 0."""
    types = t["events"].select("event_type").distinct()
    end = t["events"].agg(F.max("ts")).first()[0]
    return types.select(
        F.lit(-1).alias("event_id"), (F.lit(end) + F.expr("interval 3650 days")).alias("ts"), F.lit(-1).alias("user_id"), "event_type",
        F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"),
    )


def closed_events(t: Inputs) -> tuple[SparkSession, DataFrame, Callable[[], None]]:
    """A session, its event stream, and what ends the stream once all its files are read."""
    session = stream_session(t.spark)
    closing = Closing(session, t["events"].schema)
    events = closing.after(file_stream(session, t.folder, "events", t["events"].schema))
    return session, events, lambda: closing.write(last_events(t))


# --- class state ------------------------------------------------------------------------

EMA = f"with {OBS} select point_id, target as class_id, sum({ALPHA} * {SCALE} * conf * power(1 - {ALPHA}, total - n)) as logit from ob group by point_id, target"


@query("observation_ema", "point_id:i class_id:i logit:d", EMA)
def _(t: Inputs) -> DataFrame:
    return sf.observation_ema(t["fx_observations"], CLASS_COUNT, ALPHA, SCALE)


@query("observation_ema_stream", "point_id:i class_id:i logit:d", EMA)
def _(t: Inputs) -> DataFrame:
    (observations,) = event_streams(t, "fx_observations")
    emitted = run_append(so.ema_partials(observations, CLASS_COUNT, ALPHA, SCALE, delay(t)), "ema")
    return so.composed_ema(emitted, ALPHA)


EVIDENCE = f"with {OBS}, e as (select point_id, target as class_id, sum(conf) as evidence, max(conf) as support_max from ob group by point_id, target) "


@query(
    "observation_cumulative", "point_id:i class_id:i evidence:d logit:d",
    EVIDENCE + f"select e.*, {SCALE} * evidence / sum(evidence) over (partition by point_id) as logit from e",
)
def _(t: Inputs) -> DataFrame:
    return sf.observation_cumulative(t["fx_observations"], CLASS_COUNT, SCALE)


@query("evidence_stream", "point_id:i class_id:i evidence:d support_max:d", EVIDENCE + "select * from e")
def _(t: Inputs) -> DataFrame:
    """Update mode: the last batch that touched a point and class holds its total."""
    (observations,) = event_streams(t, "fx_observations")
    written = run_update(so.evidence(observations, CLASS_COUNT), "evidence")
    return written.groupBy("point_id", "class_id").agg(
        F.max_by("evidence", "batch").alias("evidence"), F.max_by("support_max", "batch").alias("support_max")
    )


@query(
    "evidence_history", "point_id:i seq:i evidence:d",
    f"""select point_id, seq, sum(conf) over (partition by point_id, target order by ts, seq rows unbounded preceding) as evidence from {{fx_observations}}
    where target between 1 and {CLASS_COUNT - 1} and conf > 0""",
)
def _(t: Inputs) -> DataFrame:
    return sf.evidence_history(t["fx_observations"], CLASS_COUNT)


# The rule replayed one observation at a time.
SWITCHED = f"""select st.* from (with recursive {OBS},
 st as (select point_id, n, total, target as label, {ALPHA} * conf * {SCALE} as strength, 0 as pending_label, 0.0::double as pending_support from ob where n = 1
  union all
  select o.point_id, o.n, o.total,
    case when st.label = o.target then st.label when (case when st.pending_label = o.target then st.pending_support + o.conf else o.conf end) >= {SWITCH} then o.target else st.label end,
    case when st.label = o.target then (1 - {ALPHA}) * st.strength + {ALPHA} * o.conf * {SCALE}
         when (case when st.pending_label = o.target then st.pending_support + o.conf else o.conf end) >= {SWITCH} then o.conf * {SCALE} else st.strength end,
    case when st.label = o.target or (case when st.pending_label = o.target then st.pending_support + o.conf else o.conf end) >= {SWITCH} then 0 else o.target end,
    case when st.label = o.target or (case when st.pending_label = o.target then st.pending_support + o.conf else o.conf end) >= {SWITCH} then 0
         else (case when st.pending_label = o.target then st.pending_support + o.conf else o.conf end) end
  from st join ob o on o.point_id = st.point_id and o.n = st.n + 1)
 select * from st) st where n = total"""
SWITCH_SHAPE = "point_id:i label:i strength:d pending_label:i pending_support:d"


@query("observation_switch", SWITCH_SHAPE, SWITCHED)
def _(t: Inputs) -> DataFrame:
    return sf.observation_switch(t["fx_observations"], CLASS_COUNT, ALPHA, SCALE, SWITCH)


@query("observation_switch_stream", SWITCH_SHAPE, SWITCHED)
def _(t: Inputs) -> DataFrame:
    (observations,) = event_streams(t, "fx_observations")
    emitted = run_append(so.switch_partials(observations, CLASS_COUNT, ALPHA, SCALE, SWITCH, delay(t)), "switch")
    return so.composed_switch(emitted, CLASS_COUNT, ALPHA, SCALE, SWITCH)


@query("support_max", "point_id:i support:d", f"with {OBS} select point_id, max(conf) as support from ob group by point_id")
def _(t: Inputs) -> DataFrame:
    return sf.support_max(t["fx_observations"], CLASS_COUNT)


@query(
    "support_sum", "point_id:i support:d observations:i",
    f"select point_id, sum(case when target between 1 and {CLASS_COUNT - 1} then conf else 0 end) as support, sum(case when target between 1 and {CLASS_COUNT - 1} then 1 else 0 end) as observations from {{fx_observations}} group by point_id",
)
def _(t: Inputs) -> DataFrame:
    return sf.support_sum(t["fx_observations"], CLASS_COUNT)


def gated_text(scale: float) -> str:
    cells = ", ".join(f"coalesce(sum(case when class_id = {c} then logit end), 0) as l{c}" for c in range(CLASS_COUNT))
    total = " + ".join(f"exp(l{c})" for c in range(CLASS_COUNT))
    best = f"greatest({', '.join(f'l{c}' for c in range(CLASS_COUNT))})"
    pick = "case " + " ".join(f"when l{c} = {best} then {c}" for c in range(CLASS_COUNT)) + " end"
    return f"""with em as ({EMA}), l as (select point_id, {cells} from em group by point_id),
    s as (select point_id, sum(conf) as support from {{fx_observations}} where target between 1 and {CLASS_COUNT - 1} group by point_id),
    c as (select l.*, support * {scale} as support, exp({best}) / ({total}) as top, {pick} as cls from l join s on l.point_id = s.point_id)
    select point_id, case when support >= 0.5 and top >= 0.35 then cls else 0 end as label, top * least(greatest(support, 0), 1) as confidence from c"""


@query("export_decision", "point_id:i label:i confidence:d", gated_text(0.02))
def _(t: Inputs) -> DataFrame:
    """Support is scaled down so that both bounds decide some points."""
    logits = sf.logit_arrays(sf.observation_ema(t["fx_observations"], CLASS_COUNT, ALPHA, SCALE), CLASS_COUNT)
    support = sf.support_sum(t["fx_observations"], CLASS_COUNT).select("point_id", (F.col("support") * 0.02).alias("support"))
    return sf.export_decision(logits.join(support, "point_id"))


@query(
    "incremental_append", "point_id:i class_id:i evidence:d pending_label:i pending_support:d is_new:b",
    EVIDENCE + f"""select point_id, class_id, evidence, 0 as pending_label, 0.0 as pending_support, false as is_new from e
    union all select 1000000000 + frame_index * 1000000 + point_idx % 1000000, label, r * {SCALE} / {SCALE}, 0, 0.0, true from {{fx_points}}""",
)
def _(t: Inputs) -> DataFrame:
    current = sf.observation_cumulative(t["fx_observations"], CLASS_COUNT, SCALE).select(
        "point_id", "class_id", "evidence", F.lit(0).alias("pending_label"), F.lit(0.0).alias("pending_support")
    )
    fresh = t["fx_points"].select(
        (F.lit(1000000000) + F.col("frame_index").cast("bigint") * 1000000 + F.col("point_idx") % 1000000).alias("point_id"),
        F.col("label").alias("class_id"), (F.col("r") * SCALE).alias("strength"),
    )
    return sf.incremental_append(current, fresh, SCALE)


@query(
    "replay_window", "frame_index:i points:i",
    """with k as (select distinct frame_index from {fx_points} where (frame_index + 1) % 5 = 0 order by frame_index desc limit 8)
    select frame_index, count(*) as points from {fx_points} where frame_index in (select frame_index from k) group by frame_index""",
)
def _(t: Inputs) -> DataFrame:
    """Only the last eight keyframes contribute."""
    keyframes = t["fx_points"].where((F.col("frame_index") + 1) % 5 == 0)
    window = sf.replay_window(keyframes, 8)
    return t["fx_points"].join(window, "frame_index", "left_semi").groupBy("frame_index").agg(F.count(F.lit(1)).alias("points"))


# --- streams -----------------------------------------------------------------------------------

@query("frame_ingest_stream", "frame_id:i is_keyframe:b", "select frame_id, frame_id % 5 = 4 as is_keyframe from {fx_frames}")
def _(t: Inputs) -> DataFrame:
    (frames,) = event_streams(t, "fx_frames")
    return run_append(so.frame_ingest(frames, 5, 4).select("frame_id", "is_keyframe"), "frames")


@query("stream_scan_match", "frame_id:i scan_id:i gap_s:d", f"with {NEAREST} select frame_id, scan_id, case when scan_id >= 0 then gap_s end as gap_s from nm")
def _(t: Inputs) -> DataFrame:
    session, events, close = closed_events(t)
    frames, scans = (session.sql(DERIVED[n], events=events) for n in ("fx_frames", "fx_scans"))
    found = run_append(so.scan_match(frames, scans, TOLERANCE_S, delay(t)), "matches", close)
    return found.where(F.col("frame_id") >= 0)


@query(
    "stream_frame_metrics", "window_start:i event_type:s frames:i total:d largest:d",
    """select epoch(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'))::bigint as window_start, event_type, count(*) as frames, sum(value) as total, max(value) as largest from {events}
    group by time_bucket(interval 6 hours, ts, timestamp '1970-01-01'), event_type""",
)
def _(t: Inputs) -> DataFrame:
    """The last batch that touched a window holds its counters."""
    (events,) = event_streams(t, "events")
    written = run_update(so.frame_metrics(events, delay(t)), "metrics")
    last = written.groupBy("window_start", "event_type").agg(F.max_by(F.struct("frames", "total", "largest"), "batch").alias("s"))
    return last.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "s.*")


# Frames arrive as events; the map's frames are numbered alike.
ARRIVALS = "select ts, event_type, cast(floor(event_id * 6 / 1000) as int) as frame_index from {events} where event_type in ('view', 'click', 'purchase')"
COUNTERS = f"""{DYNAMIC}, {HOLES}, fc as (select v.frame_index, visible, kept, dynamic, coalesce(masked, 0) as masked, inserted
  from (select frame_index, count(*) as visible, sum(kept::int) as kept, sum((motion = 'dynamic')::int) as dynamic from ts group by frame_index) v
  left join (select frame_index, count(*) as masked from dm group by frame_index) m on m.frame_index = v.frame_index
  join (select frame_index, sum(inserted::int) as inserted from hi group by frame_index) i on i.frame_index = v.frame_index)"""


def frame_counters(t: Inputs) -> DataFrame:
    """Per frame of the map: points seen, kept and dynamic, pixels masked and points inserted.

    Points are judged once and written, as three counters read them; places are kept of the dynamic ones.
    """
    places = [F.when(F.col("motion") == "dynamic", F.col(c)).alias(c) for c in ge.XYZ]
    judged = cut_lineage(supported(t).select("frame_index", *places, "kept", "motion"), "support")
    seen = dynamic_projected(t, judged)
    support = judged.groupBy("frame_index").agg(
        F.count(F.lit(1)).alias("visible"), F.count_if(F.col("kept")).alias("kept"), F.count_if(F.col("motion") == "dynamic").alias("dynamic")
    )
    masked = ge.dynamic_mask_stats(ge.dynamic_mask(seen, 2, CAMERA)).select("frame_index", F.col("masked_pixels").alias("masked"))
    placed = inserted(t, numbered(t).select("frame_index", "point_idx", *ge.XYZ), carry=())
    filled = ge.insertion_counters(t["fx_points"], placed).select("frame_index", "inserted")
    return support.join(masked, "frame_index", "left").join(filled, "frame_index").select("frame_index", "visible", "kept", "dynamic", F.coalesce("masked", F.lit(0)).alias("masked"), "inserted")


@query(
    "stream_frame_counters", "window_start:i event_type:s frames:i visible:i kept:i dynamic:i masked:i inserted:i",
    f"""with {COUNTERS} select epoch(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'))::bigint as window_start, event_type, count(*) as frames, coalesce(sum(visible), 0) as visible,
    coalesce(sum(kept), 0) as kept, coalesce(sum(dynamic), 0) as dynamic, coalesce(sum(masked), 0) as masked, coalesce(sum(inserted), 0) as inserted
    from ({ARRIVALS}) a left join fc on fc.frame_index = a.frame_index group by 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    """Every window comes out once, when the watermark passes it."""
    session, events, close = closed_events(t)
    frames = session.sql(ARRIVALS, events=events)
    counted = run_append(so.counted_frames(frames, saved(session, frame_counters(t), "counters"), delay(t)), "counters", close)
    return counted.withColumn("window_start", F.unix_seconds("window_start"))


KEYFRAMES = "select user_id as camera, event_id as frame_id, ts from {events} where event_id % 5 = 4 or event_id < 0"
KEYED = "kf as (select *, row_number() over (partition by camera order by ts, frame_id) as no, count(*) over (partition by camera) as many from ({}) k where frame_id >= 0)".format(KEYFRAMES)


def rings(t: Inputs, size: int) -> DataFrame:
    session, events, close = closed_events(t)
    return run_append(so.keyframe_ring(session.sql(KEYFRAMES, events=events), size, delay(t)), "ring", close).where(F.col("frame_id") >= 0)


@query(
    "keyframe_ring_stream", "camera:i frame_id:i support_frame:i back:i",
    f"with {KEYED} select a.camera, a.frame_id, b.frame_id as support_frame, a.no - b.no as back from kf a join kf b on a.camera = b.camera and b.no between a.no - 4 and a.no - 1",
)
def _(t: Inputs) -> DataFrame:
    """Each camera keeps its last four keyframes."""
    return rings(t, 4).select("camera", "frame_id", F.posexplode("earlier").alias("back", "support_frame")).withColumn("back", F.col("back") + 1)


@query("replay_window_stream", "camera:i frame_id:i", f"with {KEYED} select camera, frame_id from kf where no > many - 8")
def _(t: Inputs) -> DataFrame:
    """The last keyframe of a camera and the seven in its ring."""
    last = rings(t, 7).groupBy("camera").agg(F.max_by(F.struct("frame_id", "earlier"), F.struct("us", "frame_id")).alias("s"))
    return last.select("camera", F.explode(F.concat(F.array("s.frame_id"), F.col("s.earlier"))).alias("frame_id"))


# Points of the saved map: four of five, with their observations up to the middle of the month.
SAVED = "point_id % 5 <> 0 and ts < timestamp '2024-01-16 00:00:00'"


@query(
    "incremental_append_stream", "point_id:i class_id:i evidence:d is_new:b",
    f"""select point_id, target as class_id, sum(conf) as evidence, not bool_or(bool_or({SAVED})) over (partition by point_id) as is_new
    from {{fx_observations}} where target between 1 and {CLASS_COUNT - 1} and conf > 0 group by point_id, target""",
)
def _(t: Inputs) -> DataFrame:
    """The stream starts from a saved map; untouched points of the map stay as they were saved."""
    session = stream_session(t.spark)
    known = t["fx_observations"].where(SAVED)
    start = saved(session, sf.observation_cumulative(known, CLASS_COUNT, SCALE).select("point_id", F.col("class_id").cast("int").alias("class_id"), "evidence"), "map")
    events = file_stream(session, t.folder, "events", t["events"].schema)
    rest = session.sql(DERIVED["fx_observations"], events=events).where(f"not ({SAVED})")
    touched = run_append(so.appended_map(start, rest, CLASS_COUNT), "appended")
    last = touched.groupBy("point_id").agg(F.max_by(F.struct("is_new", "evidence"), "seen").alias("s"))
    now = last.select("point_id", F.posexplode("s.evidence").alias("class_id", "evidence"), "s.is_new").where("evidence > 0")
    return now.unionByName(start.join(last, "point_id", "left_anti").withColumn("is_new", F.lit(False)))

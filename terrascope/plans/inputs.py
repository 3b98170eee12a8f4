"""Operator inputs derived from the given tables.

Each text is one statement that Spark SQL and DuckDB both run. Frames are cut from
the order key, so their number grows with the tables while a frame keeps its size.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

ORDERS_PER_FRAME = 250

DERIVED: dict[str, str] = {}

# Camera frames and labelled scans: two time series of one event stream, which together hold all of it.
DERIVED["fx_frames"] = "select event_id as frame_id, ts from {events} where event_type in ('view', 'click', 'purchase')"
DERIVED["fx_scans"] = "select event_id as scan_id, ts from {events} where event_type not in ('view', 'click', 'purchase')"

# Frame-to-scan alignment: two neighbours share a scan, every 17th frame is unmatched.
DERIVED["fx_alignment"] = """
select distinct cast(floor(l_orderkey / 250) as int) as frame_index,
  case when floor(l_orderkey / 250) % 17 = 16 then -1
       else cast(floor(floor(l_orderkey / 250) / 2) + 900 as int) end as label_scan_index
from {lineitem}"""

# One pose per frame: a slow swing about y with a small drift.
DERIVED["fx_poses"] = """
select frame_index, cos(0.15 * sin(frame_index * 0.1)) as qw, cast(0 as double) as qx,
  sin(0.15 * sin(frame_index * 0.1)) as qy, cast(0 as double) as qz,
  (frame_index % 50) * cast(0.02 as double) as tx, cast(0 as double) as ty, (frame_index % 50) * cast(0.01 as double) as tz
from (select distinct cast(floor(l_orderkey / 250) as int) as frame_index from {lineitem}) f"""

# World points; point_idx is the cloud order within a frame.
DERIVED["fx_points"] = """
select cast(floor(l_orderkey / 250) as int) as frame_index,
  cast((l_orderkey % 250) * 1048576 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 as bigint) as point_idx,
  (l_partkey % 1000) / cast(100 as double) - 5 as x, (l_suppkey % 100) / cast(20 as double) - 2 as y,
  l_quantity / 5 as z, cast(l_linenumber as int) as label,
  l_discount * 10 as r, l_tax * 10 as g, (l_linenumber % 8) / cast(8 as double) as b
from {lineitem}"""

# Reference raster 64 x 48, sparse; ref 1-6 primary, 7 excluded; region -1 uncovered.
DERIVED["fx_pixels"] = """
select frame_index, u, v, ref, conf_u8,
  case when (u + v) % 11 = 0 then -1 else cast(floor(u / 8) + 8 * floor(v / 8) as int) end as region,
  case when (u * 3 + v) % 13 = 0 then 0 else 1 end as alpha
from (select cast(floor(l_orderkey / 250) as int) as frame_index, cast(l_partkey % 64 as int) as u, cast(l_suppkey % 48 as int) as v,
        min(l_linenumber) as ref, cast(round(min(l_discount) * 2550) as int) as conf_u8
      from {lineitem} group by floor(l_orderkey / 250), l_partkey % 64, l_suppkey % 48) p"""

# Class scores per pixel in hundredths, with many ties on purpose.
DERIVED["fx_scored"] = (
    "select *, " + ", ".join(
        f"((u * 31 + v * 17 + frame_index * 7 + {c} * 13 + case when {c} = ref then 40 else 0 end) % 101)"
        f" / cast(100 as double) as s{c}"
        for c in range(1, 7)
    ) + " from {fx_pixels}"
)

# Second score set of the same pixels: a coarser stage of the labelling chain.
DERIVED["fx_coarse"] = (
    "select *, " + ", ".join(
        f"((region * 29 + frame_index * 5 + {c} * 23 + case when {c} = ref then 25 else 0 end + 101) % 101)"
        f" / cast(100 as double) as c{c}"
        for c in range(1, 7)
    ) + " from {fx_scored}"
)

# Dense depth raster 16 x 12 with sparse measurements.
DERIVED["fx_depth"] = """
select frame_index, u, v, predicted,
  case when lines % 3 = 0 then predicted + (top_discount - 0.05) * 2 else cast(0 as double) end as measured,
  5 + 0.001 * pi() * (mean_quantity - 20) as rendered, color, gt_color, ref, conf
from (select cast(floor(l_orderkey / 250) as int) as frame_index, cast(l_partkey % 16 as int) as u, cast(l_suppkey % 12 as int) as v,
        5 + 0.0016 * pi() * (avg(l_quantity) - 25) as predicted, avg(l_quantity) as mean_quantity, max(l_discount) as top_discount,
        min(l_tax) * 10 as color, min(l_discount) * 8 as gt_color, min(l_linenumber) as ref, max(l_discount) * 10 as conf,
        count(*) as lines
      from {lineitem} group by floor(l_orderkey / 250), l_partkey % 16, l_suppkey % 12) d"""

# Region vectors of every embedding, 25 regions to a frame.
DERIVED["fx_regions"] = """
select cast(floor(vec_id / 25) as int) as frame_index, cast(vec_id % 25 as int) as region, vec_id, embedding as feature,
  cast(label as int) as label, 0.5 + (vec_id % 50) / cast(100 as double) as predicted_iou,
  0.6 + (vec_id % 40) / cast(100 as double) as stability
from {embeddings}"""

# Two prompts per label, one from each half of its vectors, and four negatives (-1).
DERIVED["fx_prompts"] = """
select cast(label + 1 as int) as class_id, cast(vec_id % 2 as bigint) as query_id, min_by(embedding, vec_id) as feature
from {embeddings} group by label, vec_id % 2
union all
select -1 as class_id, cast(vec_id % 4 as bigint) as query_id, max_by(embedding, vec_id) as feature
from {embeddings} group by vec_id % 4"""

# Rectangular masks, twenty to a frame.
DERIVED["fx_masks"] = """
select cast(floor(p_partkey / 20) as int) as frame_index, cast(p_partkey as int) as mask_id,
  cast((p_partkey * 7) % 40 as int) as x0, cast(p_size % 30 as int) as y0, cast(4 + (p_size * 3) % 20 as int) as w,
  cast(4 + p_partkey % 16 as int) as h, 0.55 + ((p_partkey * 13) % 45) / cast(100 as double) as score,
  cast(p_partkey % 3 as int) as level
from {part}"""

# Ordered class observations per map point; conf in [0, 1).
DERIVED["fx_observations"] = """
select user_id as point_id, event_id as seq, ts,
  case event_type when 'view' then 1 when 'click' then 2 when 'error' then 3 when 'signup' then 4 else 5 end as target,
  (event_id % 97) / cast(97 as double) as conf
from {events}"""


def placeholders(text: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(text) if name]


def required(text: str) -> list[str]:
    """Derived inputs a text needs, in the order they must be defined."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in ordered:
            for inner in placeholders(DERIVED[name]):
                visit(inner)
            ordered.append(name)

    for name in placeholders(text):
        visit(name)
    return ordered


def oracle_text(body: str, shape: str) -> str:
    """DuckDB statement: derived inputs as CTEs, then the typed projection of ``body``."""
    names = required(body)
    plain = {n: n for n in (*BASE_TABLES, *DERIVED)}
    ctes = [f"{n} as ({DERIVED[n].format(**plain).strip()})" for n in names]
    prefix = "with " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{prefix}select {', '.join(_sql_column(c) for c in columns_of(shape))}\nfrom ({body.format(**plain).strip()}) q"


def columns_of(shape: str) -> list[tuple[str, str]]:
    """``"frame_index:i depth:d"`` as (name, kind) pairs; i, d, s, b are the kinds."""
    return [tuple(item.split(":")) for item in shape.split()]


def _sql_column(column: tuple[str, str]) -> str:
    name, kind = column
    if kind == "i":
        return f"cast({name} as bigint) as {name}"
    if kind == "d":
        return f"round(cast({name} as double), 6) + 0.0 as {name}"
    if kind == "b":
        return f"cast({name} as boolean) as {name}"
    return f"cast({name} as varchar) as {name}"


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """Same typed projection on the Spark side."""
    cast = {"i": "bigint", "s": "string", "b": "boolean"}
    return df.select(
        *[
            (F.round(F.col(n).cast("double"), 6) + F.lit(0.0)).alias(n) if k == "d" else F.col(n).cast(cast[k]).alias(n)
            for n, k in columns_of(shape)
        ]
    )


class Inputs:
    """Given tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in DERIVED:
                text = DERIVED[name]
                self._made[name] = self.spark.sql(text, **{n: self[n] for n in placeholders(text)})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

"""String rules for labels, frame names and prompts."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: What each byte becomes in a file-safe label.
_SAFE = bytes(b if re.fullmatch(rb"[0-9A-Za-z_-]", bytes([b])) else ord("_") for b in range(256))


def _safe(labels: pa.Array) -> pa.Array:
    """The bytes of all labels replaced at once; lengths stay, so the places of the labels do."""
    valid, places, data = labels.buffers()
    cleaned = pa.py_buffer(data.to_pybytes().translate(_SAFE) if data else b"")
    labels = pa.Array.from_buffers(labels.type, len(labels), [valid, places, cleaned], offset=labels.offset)
    return pc.if_else(pc.equal(labels, ""), "query", labels).cast(pa.string())


def safe_label(label: Column) -> Column:
    """Byte-wise file-safe label.

    Every byte of the UTF-8 text outside the allowed set becomes exactly one underscore. A
    pattern would take some 1.2 seconds a MB of prose, where every sixth byte is replaced.
    """
    return F.arrow_udf(_safe, StringType())(label.cast("string"))


def frame_index_from_name(name: Column) -> Column:
    """Trailing digits of the stem as INT, -1 when absent or out of range."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, "([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("int")), F.lit(-1))


def frame_name(frame: Column, width: int = 6) -> Column:
    return F.concat(F.lpad(frame.cast("string"), width, "0"), F.lit(".png"))


def render_template(template: str, query: Column) -> Column:
    """Put the query into every ``{}`` or ``{query}`` of the template."""
    parts = template.replace("{query}", "{}").split("{}")
    pieces: list[Column] = []
    for position, part in enumerate(parts):
        if position:
            pieces.append(query)
        if part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)

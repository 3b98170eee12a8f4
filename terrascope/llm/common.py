"""Helpers shared by the corpus operators: text measures, tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.session import cut_lineage

#: The six ASCII white-space characters that separate words, as a regular expression class and as text.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """The words of ``text`` with one space between them; replacing bytes is far cheaper than a pattern."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return let(F.trim(text), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def bare(text: Column) -> Column:
    """``text`` without white space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """Number of words; null and empty text have none. Memory stays near the size of the text."""
    count = lambda t: F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    return let(spaced(F.coalesce(text, F.lit(""))), count).cast("long")


def words_of(text: Column) -> Column:
    return let(spaced(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hashed_sample(rows: DataFrame, most: int, total: int, *by: str) -> DataFrame:
    """At most ``most`` of ``total`` rows, those with the smallest hash of the columns ``by``.

    A cut on the hash first leaves few more rows than that in the whole table, so the tasks
    do not each send ``most`` rows to the one that picks.
    """
    draw = F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(1 << 40))
    share = min(1.0, (1.2 * most + 200) / max(total, 1))
    return rows.where(draw < int(share * (1 << 40))).orderBy(draw, *by).limit(most)


def group_key(column: Column) -> Column:
    """A key that is never null, so that null forms a group of its own in plain equi-joins."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


EDGES_PER_FILE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an edge list ``(a, b)``: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then follows the label's
    own label, so long chains halve. Labels are written to the shared folder after each
    round, in as few files as their number asks for; only counts reach the driver. An empty
    edge list gives no rows.
    """
    both = cut_lineage(edges.where("a != b").select("a", "b").union(edges.where("a != b").select("b", "a")).distinct(), "edges")
    parts = both.count() // EDGES_PER_FILE + 1
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")).coalesce(parts), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(seen, "node").select("node", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = cut_lineage(closer.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("changed")).coalesce(parts), "labels")
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels

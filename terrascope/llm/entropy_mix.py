"""Mix sources to target weights by entropy balancing.

Each source gets a target of tokens. Document rates within a source are the nearest ones,
in relative entropy, to one copy each that meet the target and stay within ``cap``: the
dual solution is ``min(cap, exp(tilt * size))`` with one tilt per source. The duals are
solved for all sources at once by Newton steps held inside a bracket. A step needs only how
many documents of each size a source has, so the documents are read once and every
iteration runs on that table of counts. Rates become whole copies cell by cell with the
error carried on, and copies go to the documents of a cell in order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrascope.llm.common import group_key, word_count
from terrascope.session import cut_lineage

#: Weights of the sources in order of their names, repeating; tokens wanted over tokens there; most copies.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Newton stops at this share of a target, or after so many steps; documents of a cell that are ordered together.
TOLERANCE, STEPS, RANKED = 1e-6, 60, 1000


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")).withColumn("grp", group_key(F.col("source")))


def weighted_targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(grp, source, source_size, target)`` from ``(grp, source, source_size)``, one row per source.

    The windows over all rows are over sources, not documents. Sources in the order of the
    level ``cap * source_size / weight`` at which they are full: each is full if the level
    left by those before it is above its own; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = totals.withColumn("weight", w.cast("double")).withColumn("most", cap * F.col("source_size").cast("double"))
    everyone = Window.partitionBy()
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "grp").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_level), F.lit(0.0))
    rest = share * F.sum("source_size").over(everyone) - before("most")
    rows = rows.withColumn("level", F.greatest(rest, F.lit(0.0)) / (F.sum("weight").over(everyone) - before("weight")))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everyone)
    return rows.withColumn("common", common).select("grp", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def tilts(counts: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """``(grp, scale, tilt)``: the dual of each source; rates are ``least(cap, exp(tilt * size / scale))``.

    ``counts`` has ``(grp, size, n)``. A source whose target is ``cap`` times its size has an
    infinite tilt, one with target 0 a tilt of minus infinity.
    """
    live = counts.where("size > 0")
    means = live.groupBy("grp").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.sum(F.col("size") * F.col("n")).alias("total"))
    inf = F.lit(float("inf"))
    edge = F.when(F.col("target") >= cap * F.col("total") * (1 - 1e-12), inf).when(F.col("target") <= 0, -inf)
    state = cut_lineage(means.join(targets.select("grp", "target"), "grp").select("grp", "scale", "target", F.coalesce(edge, F.lit(0.0)).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), edge.isNotNull().alias("done")), "tilts")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        raised = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        tokens = F.col("n") * F.col("size")
        moments = live.join(state.where("not done").select("grp", "scale", "tilt"), "grp").groupBy("grp").agg(
            F.sum(tokens * F.least(F.lit(float(cap)), raised)).alias("got"), F.sum(F.when(raised < cap, tokens * x * raised).otherwise(0.0)).alias("slope")
        )
        rows = state.join(moments, "grp", "left")
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("high"))
        near = F.col("done") | (F.abs(gap) <= tolerance * F.col("target"))
        rows = rows.select("grp", "scale", "target", "tilt", low.alias("low"), high.alias("high"), "done", near.alias("near"), gap.alias("gap"), "slope")
        newton = F.col("tilt") + F.when(F.col("slope") > 0, F.col("gap") / F.col("slope"))
        inside = (newton > F.coalesce("low", -inf)) & (newton < F.coalesce("high", inf))
        # Outside the bracket: halve it, or double the distance while one end is still open.
        wide = F.when(F.col("gap") > 0, F.greatest(2 * F.col("tilt"), F.lit(1.0))).otherwise(F.least(2 * F.col("tilt"), F.lit(-1.0)))
        halved = F.coalesce((F.col("low") + F.col("high")) / 2, wide)
        stuck = F.col("near") | ((F.col("high") - F.col("low")) <= 1e-15 * F.abs(F.col("high")))
        step = F.when(stuck, F.col("tilt")).when(inside, newton).otherwise(halved)
        state = cut_lineage(rows.select("grp", "scale", "target", step.alias("tilt"), "low", "high", F.coalesce(stuck, F.col("near"), F.lit(False)).alias("done")), "tilts")
    return state.select("grp", "scale", "tilt")


def whole_copies(counts: DataFrame, solved: DataFrame, targets: DataFrame, cap: int = CAP, repairs: int = 4) -> DataFrame:
    """``(grp, size, n, rate, copies)``: copies of all documents of a size, near the target.

    Sizes run from large to small and each takes what the rounded running sum of rates
    gains, so a source is off by less than half its largest document. What is then missing, or
    too much, is made up from the largest copies that fit in, a few times over.
    """
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))))
    cells = counts.where("size > 0").join(solved, "grp").select("grp", "size", "n", rate.alias("rate"))
    run = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("grp").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    up_to = F.round(F.round(F.col("run"), 6)).cast("long")
    up_to_before = F.coalesce(F.lag(up_to).over(Window.partitionBy("grp").orderBy(F.desc("size"))), F.lit(0).cast("long"))
    cells = cells.withColumn("run", run).withColumn("copies", F.least(cap * F.col("n"), up_to - up_to_before)).drop("run")
    cells = cut_lineage(cells, "cells")
    for _ in range(repairs):
        missing = cells.groupBy("grp").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(targets.select("grp", "target"), "grp").select("grp", (F.col("target") - F.col("taken")).alias("gap"))
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        rows = cells.join(missing, "grp").withColumn("room", F.when(F.col("size") <= F.abs("gap"), room).otherwise(0))
        larger = Window.partitionBy("grp").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("left", F.abs("gap") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0)))
        moved = F.greatest(F.least(F.col("room"), F.floor(F.col("left") / F.col("size"))), F.lit(0))
        cells = cut_lineage(rows.select("grp", "size", "n", "rate", (F.col("copies") + F.when(F.col("gap") > 0, moved).otherwise(-moved)).alias("copies")), "cells")
    return cells


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    hashed = rows.withColumn("draw", F.xxhash64(F.lit("copies"), "doc_id"))
    return hashed.withColumn("part", F.pmod(F.xxhash64("draw"), F.lit(parts)))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Sizes of the documents, targets, the copies of each ``(grp, size, part)``, and the number of parts.

    Documents whose ``draw`` is at most ``last`` get one copy more than ``each``. Parts split
    the sizes that many documents share, so that no task orders them all. ``targets`` can be
    given as ``(grp, source, source_size, target)``; else they follow from the weights.
    """
    rows = cut_lineage(sized(docs), "sizes")
    counts = cut_lineage(rows.groupBy("grp", "source", "size").agg(F.count("*").alias("n")), "counts")
    if targets is None:
        totals = counts.groupBy("grp", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        targets = cut_lineage(weighted_targets(totals, weights, share, cap), "targets")
    counts = counts.select("grp", "size", "n")
    cells = whole_copies(counts, tilts(counts, targets, cap), targets, cap)
    cells = cells.select("grp", "size", "rate", "n", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra"))
    parts = int(((cells.agg(F.max("n")).first()[0] or 1) + RANKED - 1) // RANKED)
    dealt = _dealt(rows.where("size > 0").select("grp", "size", "doc_id"), parts)
    held = dealt.groupBy("grp", "size", "part").agg(F.count("*").alias("held")).join(cells, ["grp", "size"])
    up_to = F.sum("held").over(Window.partitionBy("grp", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    share_of = lambda c: F.expr(f"extra * ({c}) div n")
    held = held.withColumn("up_to", up_to).select("grp", "size", "part", "rate", "each", (share_of("up_to") - share_of("up_to - held")).alias("more"))
    held = cut_lineage(held, "held")
    rank = F.row_number().over(Window.partitionBy("grp", "size", "part").orderBy("draw"))
    last = dealt.join(held.where("more > 0").select("grp", "size", "part", "more"), ["grp", "size", "part"]).withColumn("rank", rank).where("rank = more").select("grp", "size", "part", F.col("draw").alias("last"))
    return rows, targets, cut_lineage(held.join(last, ["grp", "size", "part"], "left").drop("more"), "plan"), parts


def _copies() -> Column:
    return F.col("each") + F.when(F.col("draw") <= F.col("last"), 1).otherwise(0)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, rate, copies`` per document.

    Null and empty texts have size 0, take 0 and count as no copy. Documents without a source
    form a source of their own, named last. Rows with equal ids and sizes in one source get
    equal copies, so repeated rows can bring a source further from its target. An empty
    table gives no rows; other columns are ignored. Reruns agree.
    """
    rows, targets, dealt, parts = plan(docs, **settings)
    out = _dealt(rows, parts).join(dealt, ["grp", "size", "part"], "left").join(targets.select("grp", "source_size", "target"), "grp")
    copies = F.coalesce(_copies(), F.lit(0).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", "rate", copies.alias("copies"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The documents, each as many times as the mix takes it; documents without words stay once."""
    _, _, dealt, parts = plan(docs, **settings)
    mine = {"grp": group_key(F.col("source").cast("string")), "size": word_count(F.col("text").cast("string")), "draw": F.xxhash64(F.lit("copies"), F.col("doc_id"))}
    keys = docs.select("*", *[v.alias(f"_mix_{k}") for k, v in mine.items()]).withColumn("_mix_part", F.pmod(F.xxhash64("_mix_draw"), F.lit(parts)))
    side = dealt.select(*[F.col(c).alias(f"_mix_{c}") for c in ("grp", "size", "part", "each", "last")])
    joined = keys.join(side, ["_mix_grp", "_mix_size", "_mix_part"], "left")
    copies = F.coalesce(F.col("_mix_each") + F.when(F.col("_mix_draw") <= F.col("_mix_last"), 1).otherwise(0), F.lit(1).cast("long"))
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)

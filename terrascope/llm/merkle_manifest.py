"""Merkle manifest of a table of documents, and a recursive query that climbs it from every leaf.

Each document is a leaf, each language a tree over its leaves by doc_id, and the subroots
are the leaves of one more tree, ordered by language. While more than one node remains,
every two consecutive ones, or the last alone, become the digest of their hex texts.

The built levels are stored as rows that link a node to its ancestor ``SPAN`` levels up, or to
the root of its tree and on into the upper one, and hold the siblings passed on the way. A
Spark recursive query then climbs from every leaf along these links: each turn appends the
siblings and folds the leaf's hash, the tampered one where the leaf was tampered with. With
one level a link the growing proofs would be shuffled at every level; with eight they move a few
times in all.

The nodes near the root lie on everybody's way. A node row is repeated for each run of
``BLOCK`` leaves below it and joined by run, so no join key has more than ``BLOCK`` climbers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.functions.single import attach
from terrascope.llm.common import group_key
from terrascope.session import cut_lineage

SPAN = 8
BLOCK_BITS = 12
#: One of so many documents, by checksum of its id, is tampered with.
TAMPER_EVERY = 7
TOP = "^"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    """Binary SHA-256; rows and proofs carry 32 bytes instead of 64 characters."""
    return F.unhex(F.sha2(text, 256))


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, climbs``: the leaf's digest, and the one to climb with, which may be tampered."""
    columns = {c: F.col(c) for c in _FIELDS}
    more = columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
    digest = lambda parts: _digest(F.concat(*[_part(parts[c]) for c in _FIELDS]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("lang")).alias("tree"), digest(columns).alias("leaf"), F.when(hit, digest(more)).alias("other"))
    return rows.select("doc_id", "tree", "leaf", F.coalesce("other", "leaf").alias("climbs"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree, from 0 in the given order, and ``n``, the tree's size.

    Rows are sorted by range, so a tree may spread over any number of tasks and equal rows too;
    the place is the offset in its range plus the sizes of the tree's earlier ranges.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = ["tree", *order, "_tie"]
    ranged = cut_lineage(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return ranged.withColumn("_part", part).join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _at_level(place: Column, level: Column) -> Column:
    """Place of the ancestor so many levels up."""
    return F.call_function("shiftright", place, level)


def _levels(kids: Column, span: Column) -> Column:
    """The level of ``kids`` and the ``span`` levels above it, as arrays of digests."""
    pair = lambda below, i: _digest(F.concat(_hex(F.get(below, 2 * i)), F.coalesce(_hex(F.get(below, 2 * i + 1)), F.lit(""))))
    above = lambda below: F.transform(F.sequence(F.lit(0), ((F.size(below) - 1) / 2).cast("int")), lambda i: pair(below, i))
    steps = F.when(span > 0, F.sequence(F.lit(1), span)).otherwise(F.array().cast("array<int>"))
    return F.reduce(steps, F.array(kids), lambda built, _: F.concat(built, F.array(above(F.element_at(built, -1)))))


def _hops(n: Column) -> Column:
    return F.greatest(F.ceil(_height(n) / SPAN), F.lit(1)).cast("int")


def build(leaf_rows: DataFrame, *own: str) -> tuple[list[DataFrame], DataFrame]:
    """Links of all trees by hop, and ``tree, n, root`` of each tree.

    ``leaf_rows``: tree, n, pos, digest; those of hop 0 keep the columns ``own`` as well. A link
    goes from a node ``pos`` to its ancestor ``SPAN`` levels up, or to the root if that is ``last``;
    it holds the node's digest (as ``leaf``) and the siblings passed, null where a node was alone, and ``sides``: bit s is set if the
    sibling of level s stands on the left. A group of ``2 ** SPAN`` nodes becomes one row,
    whatever the size of its tree.
    """
    tall = leaf_rows.agg(F.max(_height(F.col("n")))).first()[0] or 0
    nodes, links, roots = leaf_rows, [], []
    for hop in range(max(1, -(-tall // SPAN))):
        kept = own if hop == 0 else ()
        low, height = hop * SPAN, _height(F.col("n"))
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest", *kept)))
        groups = nodes.groupBy("tree", "n", F.shiftright("pos", SPAN).alias("up")).agg(kids.alias("kids"))
        digests = F.transform("kids", lambda k: k["digest"])
        groups = groups.select("tree", "n", "up", "kids", (height <= low + SPAN).alias("last"), _levels(digests, F.least(F.lit(SPAN), height - low)).alias("levels"))
        groups = cut_lineage(groups, f"levels{hop}")
        each = groups.select("tree", "n", "up", "last", "levels", F.posexplode("kids").alias("i", "kid"))
        passed = F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda level, s: F.get(level, _at_level(F.col("i"), s).bitwiseXOR(F.lit(1))))
        links.append(each.select("tree", "n", "kid.pos", F.col("kid.digest").alias("leaf"), *[f"kid.{c}" for c in kept], passed.alias("siblings"), F.col("i").cast("long").alias("sides"), "last"))
        tops = groups.select("tree", "n", F.col("up").alias("pos"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "last")
        roots.append(tops.where("last").select("tree", "n", F.col("digest").alias("root")))
        nodes = tops.where("not last").drop("last")
    return links, reduce(DataFrame.unionByName, roots)


_ROWS = "spark.sql.cteRecursionRowLimit"
#: At every sibling passed the node's digest is joined with it on the side that its bit tells.
_FOLD = """aggregate(if(size(siblings) = 0, cast(array() as array<int>), sequence(0, size(siblings) - 1)), {start}, (h, s) -> unhex(sha2(concat(
    if(shiftright(sides, s) & 1 = 1, coalesce(lower(hex(siblings[s])), ''), ''), lower(hex(h)),
    if(shiftright(sides, s) & 1 = 0, coalesce(lower(hex(siblings[s])), ''), '')), 256)))"""
_APPEND = "aggregate(siblings, {start}, (b, s) -> concat(b, coalesce(s, X'')))"
#: A leaf row holds the leaf's own link; from there on every turn takes the link of the node reached.
CLIMB = f"""
with recursive climb as (
  select doc_id, leaf, tree, block, 1 as hop, next as at, {_FOLD.format(start='climbs')} as folded, {_APPEND.format(start="X''")} as passed, done from {{leaf_rows}}
  union all
  select c.doc_id, c.leaf, c.tree, c.block, c.hop + 1, n.next, {_FOLD.format(start='c.folded')}, {_APPEND.format(start='c.passed')}, n.done
  from climb c join {{node_rows}} n on n.tree = c.tree and n.block = c.block and n.hop = c.hop and n.at = c.at
)
select doc_id, leaf, tree, folded, passed from climb where done
"""


def _runs(first: Column, past: Column) -> Column:
    """The runs of ``2 ** BLOCK_BITS`` leaves that hold the leaves from ``first`` to before ``past``."""
    return F.explode(F.sequence(F.shiftright(first, BLOCK_BITS), F.shiftright(past - 1, BLOCK_BITS)))


def _onward(link: DataFrame, ways: DataFrame) -> DataFrame:
    """Columns ``next, siblings, sides, done``; the last link of a tree goes on with the first link of its subroot.

    ``ways``: the subroot's link in the upper tree, by tree.
    """
    joined = link.join(ways, "tree")
    return joined.select(
        *link.columns[: -len(("siblings", "sides", "last"))],
        F.when(F.col("last"), F.shiftright("place", SPAN)).otherwise(F.shiftright("pos", SPAN)).alias("next"),
        F.when(F.col("last"), F.concat("siblings", "_siblings")).otherwise(F.col("siblings")).alias("siblings"),
        F.when(F.col("last"), F.col("sides") + F.call_function("shiftleft", F.col("_sides"), F.size("siblings"))).otherwise(F.col("sides")).alias("sides"),
        (F.col("last") & F.col("_last")).alias("done"),
    )


def node_rows(links: list[DataFrame], upper_links: list[DataFrame], trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaf rows, and the rows ``tree, block, hop, at, next, siblings, sides, done`` of the nodes above them.

    A node has one row for each run of leaves below it. Hops of the upper tree follow those of a tree.
    """
    first = upper_links[0].select(F.col("name").alias("tree"), F.col("pos").alias("place"), F.col("siblings").alias("_siblings"), F.col("sides").alias("_sides"), F.col("last").alias("_last"))
    low = _onward(links[0], first).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    above = []
    for hop, link in enumerate(links[1:], 1):
        past = F.least((F.col("pos") + 1) * (1 << (hop * SPAN)), F.col("n"))
        above.append(_onward(link, first).select("tree", _runs(F.col("pos") * (1 << (hop * SPAN)), past).alias("block"), F.lit(hop).alias("hop"), F.col("pos").alias("at"), "next", "siblings", "sides", "done"))
    for hop, link in enumerate(upper_links[1:], 1):
        ways = trees.withColumn("pos", F.shiftright("place", hop * SPAN)).join(link.drop("tree", "n", "leaf"), "pos")
        above.append(ways.select("tree", _runs(F.lit(0).cast("long"), F.col("n")).alias("block"), (_hops(F.col("n")) + (hop - 1)).alias("hop"), F.col("pos").alias("at"), F.shiftright("pos", SPAN).alias("next"), "siblings", "sides", F.col("last").alias("done")))
    rows = reduce(DataFrame.unionByName, above) if above else low.select("tree", "block", F.lit(0).alias("hop"), F.col("pos").alias("at"), "next", "siblings", "sides", "done").where("false")
    return low, rows


def _climbed(low: DataFrame, above: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, folded, passed`` of every leaf at the root, by one recursive query.

    The session's limit of rows for recursive queries is lifted while it runs. The result is
    written, so the query runs once and under that setting.
    """
    spark = low.sparkSession
    names = {"leaf_rows": f"merkle_leaves_{uuid.uuid4().hex}", "node_rows": f"merkle_nodes_{uuid.uuid4().hex}"}
    low.createOrReplaceTempView(names["leaf_rows"])
    above.createOrReplaceTempView(names["node_rows"])
    limit = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, "-1")
    try:
        return cut_lineage(spark.sql(CLIMB.format(**names)), "climbed")
    finally:
        spark.conf.unset(_ROWS) if limit is None else spark.conf.set(_ROWS, limit)
        for name in names.values():
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per document.

    Nulls in any column count as such in the leaf; the null language is a tree of its own and
    comes first, a null doc_id comes first in its tree and is never tampered with. Repeated
    doc_ids are ordered by leaf digest, equal rows among themselves in any order. A null n_chars
    stays null when tampered with. An empty table gives no rows; other columns are not read.
    """
    rows = placed(cut_lineage(leaves(docs), "leaves"), "doc_id", "leaf")
    links, subroots = build(rows.withColumnRenamed("leaf", "digest"), "doc_id", "climbs")
    # The subroots are the leaves of the upper tree, in one series.
    named = cut_lineage(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.col("n").alias("below")), "subroots")
    series = cut_lineage(placed(named, "name"), "series")
    upper_links, top = build(series, "name")
    trees = series.select(F.col("name").alias("tree"), F.col("below").alias("n"), F.col("pos").alias("place"), F.col("digest").alias("subroot"))
    low, above = node_rows(links, upper_links, trees)
    climbed = _climbed(low, cut_lineage(above, "nodes")).join(trees.select("tree", "subroot"), "tree")
    out = attach(climbed, top.agg(F.max("root").alias("root")))
    return out.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(_hex(F.col("passed")), 256).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )

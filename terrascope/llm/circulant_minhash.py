"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard on full shingle sets.

All coordinates of a signature come from two permutations of the 32-bit numbers: the first
scatters the elements of a set, the second is read at circular shifts 0, 1, 2, ..., one
shift per coordinate. Bands of coordinates are hashed to bucket keys. Documents that share
a bucket are compared on their full sets, but a bucket's pairs are not made for it. In each
turn a bucket names one head, and every member still lying in another component meets the
one head that it shares most buckets with; linked documents are merged. Turns go on while
they close buckets. What is open then is compared pair by pair if that is little, else by
a prefix filter: sets in the order of rarity, of which two similar ones have their first
common element at places that their sizes bound, and differ in few elements. So every pair
of a bucket is compared, ruled out by these bounds, or known to be connected, and a group
of thousands of copies costs a row per member and turn.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import components, group_key
from terrascope.session import cut_lineage

#: Words in a shingle and least similarity (as a fraction numerator / 100) of linked documents.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Coordinates per band, and the chance of missing a pair right at the threshold.
BAND_ROWS, MISS = 4, 1e-7

#: All open pairs of buckets are compared once they are at most so many times the open members;
#: turns end when one leaves more than this share of them open.
FEW, SHRINK = 2, 0.9
#: Usual number of documents compared with one head in a group, counters of the elements' rarity,
#: rows of one element that meet in a part, and longs of parities.
GROUP, BINS, PART, LONGS = 64, 1 << 20, 1024, 16

_CHUNK = 8192
_NODE = "struct<missing:boolean,id:long,digest:binary>"
_SIG = "doc_id long, n_shingles long, digest binary, keys array<long>"


def bands_needed(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands for which a pair at the threshold shares no bucket with at most chance ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _permute32(x: np.ndarray, odd: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd products and xor-shifts can all be undone."""
    x = x * np.uint32(odd)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return x


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit values of the distinct shingles; a shorter text is one shingle, an empty one has none."""
    words = text.lower().split()  # on bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(w))
    acc = np.full(len(w) - span + 1, span, np.uint64)
    for k in range(span):
        acc = _mix64(acc + w[k : len(w) - span + 1 + k])
    return np.unique(acc)


def band_keys(shingles: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """Bucket keys of a set, one per band."""
    if not len(shingles):
        return np.empty(0, np.int64)
    shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), _CHUNK):
        scattered = _permute32((shingles[at : at + _CHUNK] >> np.uint64(32)).astype(np.uint32), 0x9E3779B1)
        least = np.minimum(least, _permute32(scattered[None, :] + shifts, 0x85EBCA77).min(axis=1))
    acc = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(bands, rows).T:
        acc = _mix64(acc + column)
    return acc.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys)`` of every document; the digest names its shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"", width)
                sizes.append(len(s))
                digests.append(_digest(s))
                keys.append(band_keys(s, bands))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, _SIG)


def _node(digest: Column, rep: Column) -> Column:
    """A class's name; names are ordered by document id, missing ids last."""
    return F.named_struct(F.lit("missing"), rep.isNull(), F.lit("id"), F.coalesce(rep, F.lit(0)), F.lit("digest"), digest)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(digest, text)`` of one document for each wanted shingle set."""
    ids = classes.join(wanted, "digest", "left_semi").select(group_key(F.col("rep")).alias("id_key")).distinct()
    rows = docs.select(group_key(F.col("doc_id").cast("long")).alias("id_key"), F.col("text").cast("string").cast("binary").alias("text")).join(ids, "id_key", "left_semi")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(shingle_set(t.as_py() or b"", width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(1)], ["digest", "text"])

    # Repeated ids can bring the same set twice or a set that nobody asked for.
    named = rows.mapInArrow(name, "digest binary, text binary").join(wanted, "digest", "left_semi")
    return cut_lineage(named.dropDuplicates(["digest"]), "texts")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets are at least ``percent`` / 100 similar.

    Pairs of one ``b`` are dealt into groups of about ``GROUP``; its text goes once to each
    of them and is followed there by the texts of its partners.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("parts"))).cast("int")
    dealt = cut_lineage(pairs.join(parts, "b", "left").select("a", "b", part.alias("part")), "pairs")
    partners = dealt.withColumn("digest", F.col("a.digest")).join(texts, "digest").select("a", "b", "part", F.lit(1).alias("turn"), "text")
    heads = dealt.select("b", "part").distinct().withColumn("digest", F.col("b.digest")).join(texts, "digest")
    rows = partners.union(heads.select(F.col("b").alias("a"), "b", "part", F.lit(0), "text"))
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "turn")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            ok = []
            for turn, text in zip(batch.column(3).to_pylist(), batch.column(4)):
                one = shingle_set(text.as_py(), width)
                if turn == 0:
                    head = one
                    ok.append(False)
                    continue
                common = len(np.intersect1d(one, head, assume_unique=True))
                ok.append(100 * common >= percent * (len(one) + len(head) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(test, f"a {_NODE}, b {_NODE}")


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of ``n`` of which a similar set, in the same order, must share one among its own."""
    return n - (n * percent + 99) // 100 + 1


def _bin(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BINS)).astype(np.int64)


def _rarity(texts: DataFrame, width: int) -> np.ndarray:
    """How many elements of all sets fall into each of ``BINS`` counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen[_bin(shingle_set(text.as_py(), width))] += 1
        at = np.nonzero(seen)[0]
        for first in range(0, len(at), 1 << 16):
            part = at[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], ["bin", "c"])

    counted = texts.select("text").mapInArrow(count, "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()  # BINS rows at most
    out = np.zeros(BINS, np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """``LONGS`` longs of which each bit tells whether an odd number of elements falls on it.

    Two sets differ in at least as many elements as their bits do.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _with_parities(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``rows`` with the parities of their ``digest`` as the struct ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([parities(shingle_set(t.as_py(), width)) for t in batch.column(1)], np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in bits.T)], ["digest", *(f"p{k}" for k in range(LONGS))])

    wanted = texts.select("digest", "text").join(rows.select("digest").distinct(), "digest", "left_semi")
    named = wanted.mapInArrow(run, "digest binary, " + ", ".join(f"p{k} long" for k in range(LONGS)))
    return rows.join(named.select("digest", F.struct(*(f"p{k}" for k in range(LONGS))).alias("bits")), "digest")


def _differ(left: Column, right: Column) -> Column:
    return reduce(operator.add, [F.bit_count(left[f"p{k}"].bitwiseXOR(right[f"p{k}"])) for k in range(LONGS)])


def _reach(n: Column, m: Column, percent: int) -> Column:
    """The last place at which a set of ``n`` can have its first element in common with a similar set of ``m``."""
    return n - F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def _prefix_pairs(open_nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``(node, n, component)`` in different components that may be similar; none that is similar is left out.

    Sets are put in one order, rare elements first. Two similar ones have their first common
    element at places that their sizes bound. Rows of an element that lie too far for
    its smallest set go first; of what is left, members of the component that the element has
    most of meet the others only.
    """
    named = open_nodes.withColumn("digest", F.col("node.digest"))
    ours = cut_lineage(texts.join(named.select("digest"), "digest", "left_semi"), "open_texts")
    rarity = texts.sparkSession.sparkContext.broadcast(_rarity(ours, width))  # BINS counters

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0), batch.column(1)):
                s = shingle_set(text.as_py(), width)
                kept = s[np.lexsort((s, rarity.value[_bin(s)]))][: prefix_length(len(s), percent)]
                columns = [pa.array([digest.as_py()] * len(kept), pa.binary()), pa.array(kept.view(np.int64)), pa.array(np.arange(len(kept)))]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "element", "place"])

    rows = ours.mapInArrow(first, "digest binary, element long, place long").join(named.select("digest", "n", F.col("component.digest").alias("of")), "digest")
    rows = cut_lineage(rows, "prefixes")
    mixed = rows.groupBy("element").agg(F.min("n").alias("least"), F.min("of").alias("low"), F.max("of").alias("high")).where("low != high").select("element", "least")
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / F.lit(100) - 1e-9))
    near = cut_lineage(rows.join(mixed, "element").where(F.col("place") <= _reach(F.col("n"), least, percent)).drop("least"), "near")
    sides = near.groupBy("element", "of").agg(F.count("*").alias("c"))
    most = sides.groupBy("element").agg(F.max(F.struct("c", "of"))["of"].alias("most"), F.count("*").alias("sides"), F.sum("c").alias("c")).where("sides > 1")
    most = most.select("element", "most", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    sided = cut_lineage(_with_parities(near.join(most, "element"), ours, width), "sided")
    left = sided.where("of != most").select("element", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.col("digest").alias("x"), "n", F.col("place").alias("i"), "of", F.col("bits").alias("p"))
    right = sided.select("element", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("digest").alias("y"), F.col("n").alias("m"), F.col("place").alias("j"), F.col("of").alias("other"), (F.col("of") == F.col("most")).alias("in_most"), F.col("bits").alias("q"))
    n, m = F.col("n"), F.col("m")
    met = left.join(right, ["element", "part"]).where("of != other and (in_most or x < y)").where((F.col("i") <= _reach(n, m, percent)) & (F.col("j") <= _reach(m, n, percent)))
    met = met.where(_differ(F.col("p"), F.col("q")) <= _reach(n, m, percent) + _reach(m, n, percent))
    pairs = cut_lineage(met.select("x", "y").distinct(), "candidates")
    names = named.select("digest", "node")
    pairs = pairs.join(names.select(F.col("digest").alias("x"), F.col("node").alias("a")), "x").join(names.select(F.col("digest").alias("y"), F.col("node").alias("b")), "y")
    return pairs.select("a", "b")


def _alike(percent: int) -> Column:
    return (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, miss: float = MISS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links, ``kept`` marks
    the document that carries it. Text without words (null, empty, spaces) has an empty set
    and no link. Equal texts form one class and are compared once. Repeated rows stay
    repeated. A null id never names a component that has another id; a component of null
    ids only has a null ``component_id``, and its rows are kept. Other columns are ignored.
    """
    bands = bands_needed(percent, miss=miss)
    signed = cut_lineage(signatures(docs, width, bands), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("rep")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(rep, F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = cut_lineage(classes, "classes")
    placed = classes.select(_node(F.col("digest"), F.col("rep")).alias("node"), "n", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = cut_lineage(placed.join(shared.select("key"), "key"), "members")

    texts = _texts(docs, classes.select("digest", "rep"), members.select(F.col("node.digest").alias("digest")).distinct(), width)
    links: DataFrame | None = None
    labels: DataFrame | None = None
    before, turn = math.inf, 0
    while True:
        at = members.withColumn("component", F.col("node"))
        if labels is not None:
            at = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        at = cut_lineage(at, "placed")
        # Pairs of a bucket that lie in different components, without making them.
        sides = at.groupBy("key", "component").agg(F.count("*").alias("c"))
        open_keys = sides.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same")).where("all * all > same")
        open_keys = cut_lineage(open_keys, "open_keys")
        left = open_keys.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not left["rows"]:
            break
        members = cut_lineage(at.join(open_keys.select("key", "all"), "key"), "open")
        few, last = left["pairs"] <= FEW * left["rows"], left["pairs"] > SHRINK * before
        if few:
            other = members.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
            pairs = members.withColumnRenamed("node", "a").join(other, "key").where("b < a and component != other").where(_alike(percent)).select("a", "b").distinct()
        elif last:
            pairs = _prefix_pairs(members.select("node", "n", "component").distinct(), texts, width, percent)
        else:
            # The first head of a bucket is the member whose buckets hold most, which lies in the middle of a crowd.
            weighed = members.withColumn("weight", F.lit(0))
            if turn == 0:
                weighed = members.join(members.groupBy("node").agg((-F.sum("all")).alias("weight")), "node")
            draw = F.struct("weight", F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n", "component")
            heads = weighed.groupBy("key").agg(F.min(draw).alias("head")).select("key", F.col("head.node").alias("b"), F.col("head.n").alias("m"), F.col("head.component").alias("other"))
            met = members.withColumnRenamed("node", "a").join(heads, "key").where("component != other").where(_alike(percent))
            best = met.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))
            pairs = best.select("a", "b")
        new = cut_lineage(_confirm(pairs, texts, width, percent), "links")
        links = new if links is None else links.union(new)
        labels = components(links)
        if few or last:
            break
        before, turn = left["pairs"], turn + 1
        members = members.drop("component", "all")

    if labels is None:
        names = classes.select("digest", F.col("rep").alias("component_id"))
    else:
        named = labels.select(F.col("node.digest").alias("digest"), F.when(~F.col("component.missing"), F.col("component.id")).alias("least"), F.lit(True).alias("linked"))
        names = classes.select("digest", "rep").join(named, "digest", "left").select("digest", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(names, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents without near copies: of each component, those rows that carry its smallest id.

    Where one id comes several times within a component, all its rows stay.
    """
    kept = near_duplicates(docs, **settings).where("kept").select(group_key(F.col("doc_id")).alias("_kept_key")).distinct()
    keyed = docs.withColumn("_kept_key", group_key(F.col("doc_id").cast("long")))
    return keyed.join(kept, "_kept_key", "left_semi").select(*docs.columns)

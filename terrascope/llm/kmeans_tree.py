"""Largest inner products by a hierarchical k-means tree and best-bin-first search.

A vector gets one more component that lifts all vectors to one length, so the largest inner
product is the smallest distance. The tree is fitted on a bounded sample; every vector is
then placed in a leaf. A query walks the tree through a priority queue of nodes, nearest
centre first, and so ranks the leaves. How many leaves are visited is widened, on
calibration queries whose exact answers are known, until the recall asked for is reached.

Vectors of a leaf and queries that lie near each other in the tree travel in packed blocks of
bounded size. A block of queries is not copied per leaf: the vectors of the leaves that a group
of blocks wants stream past it, each block is multiplied in numpy with the leaves that one of
its queries wants, and one list of answers per query leaves a task. Equal vectors are kept once with their
smallest ids, more than the number of neighbours asked for of which can never be an answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrascope.llm.common import hashed_sample
from terrascope.session import cut_lineage

#: Neighbours returned; every how many ids a query; sample of vectors that the tree is fitted on;
#: children per node and sampled vectors per leaf; rounds of k-means per node.
NEIGHBOURS, QUERY_STEP = 20, 20
SAMPLE, CHILDREN, LEAF, ROUNDS = 65_536, 8, 64, 6
#: Calibration queries, and the recall that they must reach.
CALIBRATION, RECALL = 128, 0.97
#: Answers that the block product picks beyond those asked for, one of which is the query itself.
SPARE = 9
#: Vectors and queries in a packed block, blocks in a group of queries, tasks that groups are dealt out to at least.
VECTOR_BLOCK, QUERY_BLOCK, GROUP, TASKS = 2048, 256, 32, 16

_PARTIAL = "q long, v long, score double"


class Tree:
    """Centres of all nodes; ``children[i]`` is the range of node ``i``'s children, ``leaf[i]`` its leaf number or -1."""

    def __init__(self, sample: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        centres, self.children, self.leaf = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [(0, 0)], [-1]
        todo, self.leaves = [(0, sample)], 0
        while todo:
            node, rows = todo.pop()
            groups = _split(rows, rng) if len(rows) > LEAF else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.children[node] = (len(centres), len(centres) + len(groups))
            for g in groups:
                todo.append((len(centres), g))
                centres.append(g.mean(0))
                self.children.append((0, 0))
                self.leaf.append(-1)
        self.centres = np.array(centres)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            first, end = self.children[node]
            if first == end:
                out[at] = self.leaf[node]
                continue
            near = _distances(rows[at], self.centres[first:end]).argmin(1)
            todo += [(first + k, at[near == k]) for k in range(end - first) if (near == k).any()]
        return out

    def ranked(self, near: list[float], most: int) -> list[int]:
        """The first ``most`` leaves, best bin first; ``near`` holds the query's distance to every node."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            first, end = self.children[node]
            if first == end:
                found.append(self.leaf[node])
                continue
            for k in range(first, end):
                heapq.heappush(queue, (near[k], k))
        return found


    def wanted(self, near: np.ndarray, most: int) -> np.ndarray:
        """Which leaves are among each query's first ``most``, best bin first; ``near`` has a row per query.

        The search reaches a leaf by the farthest node on the way to it, so it takes leaves in
        the order of that distance; leaves that share the node of the last one come along.
        """
        far = np.full_like(near, -np.inf)
        for node, (first, end) in enumerate(self.children):
            far[:, first:end] = np.maximum(far[:, node, None], near[:, first:end])
        out = np.empty((len(near), self.leaves))
        at = np.array(self.leaf)
        out[:, at[at >= 0]] = far[:, at >= 0]
        return out <= np.partition(out, most - 1, axis=1)[:, most - 1, None]


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None, :] - 2 * rows @ centres.T


def _split(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Groups of Lloyd's algorithm; one group if all rows are equal."""
    centres = rows[rng.choice(len(rows), min(CHILDREN, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = _distances(rows, centres).argmin(1)
        centres = np.array([rows[near == k].mean(0) for k in range(len(centres)) if (near == k).any()])
    near = _distances(rows, centres).argmin(1)
    return [rows[near == k] for k in range(len(centres)) if (near == k).any()]


def _lift(rows: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))
    return np.hstack([rows, rest[:, None]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, e)`` of the vectors that take part: not null, not zero, all components finite."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), finite.alias("_ok"))
    return rows.where("_ok").where(F.exists("e", lambda x: x != 0)).select("vec_id", "e")


def _top(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, ties to the smaller vector."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.r_[0, np.nonzero(np.diff(q))[0] + 1]
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], v[keep], s[keep]


class _Best:
    """Running best ``k`` answers of ``count`` queries, ties to the smaller vector."""

    def __init__(self, count: int, k: int) -> None:
        self.scores, self.ids = np.full((count, k), -np.inf), np.full((count, k), np.iinfo(np.int64).max)

    def add(self, product: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """``product``: scores of the vectors ``ids`` for the queries from ``first``; its last bits depend on the block."""
        k = self.scores.shape[1]
        scores, held = self.scores[first : first + len(product)], self.ids[first : first + len(product)]
        floor = scores[:, -1]
        if len(ids) > k and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(product, -k, axis=1)[:, -k])
        q, at = np.nonzero(product >= floor[:, None])
        if not len(q):
            return
        touched = np.unique(q)
        q, v, s = (np.concatenate(c) for c in ((np.repeat(touched, k), q), (held[touched].ravel(), ids[at]), (scores[touched].ravel(), product[q, at])))
        _, v, s = _top(q, v, s, k)
        held[touched], scores[touched] = v.reshape(-1, k), s.reshape(-1, k)

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero(self.ids < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(self.ids[q, at], pa.int64()), pa.array(self.scores[q, at], pa.float64())], ["q", "v", "score"])


class _Share:
    """A group of queries, in blocks, and a slice of the vectors that passes by."""

    def __init__(self, key: tuple[int, int], k: int) -> None:
        self.key, self.k, self.best = key, k, None
        self.asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.held = 0

    def ask(self, ids: np.ndarray, rows: np.ndarray, wants: np.ndarray) -> None:
        self.asked.append((ids, rows, wants))

    def meet(self, leaf: int, ids: np.ndarray, rows: np.ndarray) -> None:
        self.waiting.append((leaf, ids, rows))
        self.held += len(ids)
        if self.held >= VECTOR_BLOCK:
            self._multiply()

    def _multiply(self) -> None:
        """Each block of queries meets those leaves that one of them wants."""
        if self.best is None:
            self.best = _Best(sum(len(ids) for ids, _, _ in self.asked), self.k)
        first = 0
        for qids, queries, wants in self.asked:
            near = [(ids, rows) for leaf, ids, rows in self.waiting if wants[leaf]]
            if near:
                ids, rows = (np.concatenate(c) for c in zip(*near))
                self.best.add(queries @ rows.T, ids, first)
            first += len(qids)
        self.waiting, self.held = [], 0

    def answers(self) -> pa.RecordBatch:
        self._multiply()
        return self.best.batch(np.concatenate([ids for ids, _, _ in self.asked]))


def _best_of(partial: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every vector whose id is divisible by ``step``.

    Vectors that are null, zero, or hold a null or non-finite component take no part, as a
    query or as an answer; nor do rows without an id. All vectors must have one length; the
    most common length is taken and others take no part. A query is never its own answer;
    its copies are. A repeated row counts once; of several vectors under one id the first in the
    order of their components counts. Fewer vectors than ``k`` give all of them. Extra columns are ignored.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("e").alias("e"))
    lengths = rows.groupBy(F.size("e").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["w"]
    # Equal vectors once, under their smallest id, with the k + 1 smallest ids that can matter.
    place = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    near = rows.where(F.size("e") == width).withColumn("place", place).where(F.col("place") <= k + 1)
    grouped = near.groupBy("e").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = cut_lineage(grouped.select("rep", "ids", "e"), "vectors")
    longest = float(distinct.agg(F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    sample = hashed_sample(distinct.select("rep", "e"), SAMPLE, distinct.count(), "rep").select("e").toArrow()
    tree = spark.sparkContext.broadcast(Tree(_lift(_matrix(sample.column(0).combine_chunks(), width), longest)))  # at most SAMPLE / LEAF * 2 nodes
    leaves = tree.value.leaves

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.place(_lift(_matrix(batch.column(1), width), longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), batch.column(1)], ["rep", "leaf", "e"])

    placed = cut_lineage(distinct.select("rep", "e").mapInArrow(place_rows, "rep long, leaf long, e array<double>"), "placed")

    # Queries: each distinct vector that some query has, searched once.
    asked = rows.where((F.col("vec_id") % step == 0) & (F.size("e") == width)).join(distinct.select("rep", "e"), "e").select(F.col("vec_id").alias("query_id"), "rep")
    asked = cut_lineage(asked, "asked")
    queries = cut_lineage(placed.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "leaf", "e"), "queries")

    visits = _calibrate(queries, placed, tree, width, longest, k, recall, leaves)

    # Queries that lie near each other in the tree travel together, a block at a time.
    start = F.sum("n").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
    starts = queries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(start, F.lit(0)))  # a row per leaf
    place = F.col("start") + F.pmod(F.xxhash64("rep"), F.col("n"))
    blocks_q = _packed(queries.join(starts, "leaf").select(F.floor(place / QUERY_BLOCK).alias("block"), F.col("rep").alias("id"), "e"), width, 2 * QUERY_BLOCK, 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = []
            for data in batch.column(2):
                e = np.frombuffer(data.as_py(), "<f8").reshape(-1, width)
                near = _distances(np.hstack([e, np.zeros((len(e), 1))]), tree.value.centres)
                wants.append(np.packbits(tree.value.wanted(near, visits).any(0)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wants, pa.binary())], ["block", "ids", "data", "wants"])

    blocks_q = cut_lineage(blocks_q.mapInArrow(route, "block long, ids binary, data binary, wants binary").withColumn("group", F.floor(F.col("block") / GROUP)), "blocks")

    def leaves_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, bits in zip(*(c.to_pylist() for c in batch.columns)):
                leaf = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=leaves))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), group)), pa.array(leaf)], ["group", "leaf"])

    wanted = blocks_q.select("group", "wants").mapInArrow(leaves_wanted, "group long, leaf long").distinct()
    blocks_v = _packed(placed.select("leaf", F.col("rep").alias("id"), "e"), width, VECTOR_BLOCK, int(placed.count() / leaves // VECTOR_BLOCK) + 3)
    # A task streams a slice of the vectors past one group of queries and so sends one list a query.
    groups = blocks_q.agg(F.max("group")).first()
    slices = -(-TASKS // (1 + groups[0])) if groups[0] is not None else 1
    # Packed rows are far larger than Spark expects of them, so neither side may be broadcast.
    passing = blocks_v.join(wanted.hint("merge"), "leaf").select("group", F.pmod(F.xxhash64("ids"), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "leaf", "ids", "data", F.lit(None).cast("binary").alias("wants"))
    asking = blocks_q.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"), F.col("block").alias("leaf"), "ids", "data", "wants")
    met = asking.unionByName(passing).repartition(4 * slices * (1 + (groups[0] or 0)), "group", "slice").sortWithinPartitions("group", "slice", "kind", "leaf")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = None
        for batch in batches:
            for group, part, kind, leaf, ids, data, wants in zip(*batch.columns):
                key = (group.as_py(), part.as_py())
                if share is None or share.key != key:
                    if share is not None:
                        yield share.answers()
                    share = _Share(key, k + SPARE)
                rows = np.frombuffer(data.as_py(), "<f8").reshape(-1, width)
                if kind.as_py():
                    share.meet(leaf.as_py(), np.frombuffer(ids.as_py(), "<i8"), rows)
                else:
                    share.ask(np.frombuffer(ids.as_py(), "<i8"), rows, np.unpackbits(np.frombuffer(wants.as_py(), np.uint8), count=leaves).astype(bool))
        if share is not None:
            yield share.answers()

    # The block product picks a few more; their scores are then summed in one fixed order.
    rough = _best_of(met.mapInArrow(multiply, _PARTIAL), k + SPARE).select("q", "v")
    pairs = rough.join(queries.select(F.col("rep").alias("q"), F.col("e").alias("qe")), "q").join(distinct.select(F.col("rep").alias("v"), F.col("e").alias("ve")), "v")
    exact = F.aggregate(F.zip_with("qe", "ve", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    found = _best_of(pairs.select("q", "v", exact.alias("score")), k + 1).select(F.col("q").alias("rep"), "v", "score")
    # Back to all queries and all copies of the answers.
    answers = found.join(distinct.select(F.col("rep").alias("v"), "ids"), "v").select("rep", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    final = asked.join(answers, "rep").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(rows: DataFrame, width: int, most: int, parts: int) -> DataFrame:
    """``(key, ids, data)``: up to ``most`` rows of a key per block, packed where they lie after one exchange.

    The rows are a key, an id and a vector. A key's rows are dealt out by a hash of the id into
    ``parts``, so a key that outgrows the others fills several tasks.
    """
    key = rows.columns[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        leaf, held = None, 0

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate(data).astype("<f8").tobytes()], pa.binary())], [key, "ids", "data"])
            ids.clear(), data.clear()
            return out

        for batch in batches:
            leaves, rep, e = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            at = 0
            while at < len(leaves):
                if leaf is not None and (leaves[at] != leaf or held >= most):
                    yield block()
                    held = 0
                leaf = int(leaves[at])
                end = min(int(np.searchsorted(leaves, leaf, "right")), at + most - held)
                ids.append(rep[at:end])
                data.append(e[at:end])
                held, at = held + end - at, end
        if ids:
            yield block()

    dealt = rows.repartition(key, F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions(key)
    return dealt.mapInArrow(pack, f"{key} long, ids binary, data binary")


def _calibrate(queries: DataFrame, placed: DataFrame, tree, width: int, longest: float, k: int, recall: float, leaves: int) -> int:
    """Leaves to visit so that the calibration queries find ``recall`` of their exact neighbours."""
    chosen = queries.select("rep", "e").orderBy(F.xxhash64(F.lit("calibration"), "rep"), "rep").limit(CALIBRATION).toArrow()
    qids, q = chosen.column(0).to_numpy(), _matrix(chosen.column(1).combine_chunks(), width)
    if not len(qids):
        return 1

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(qids), k + 1)
        for batch in batches:
            best.add(q @ _matrix(batch.column(1), width).T, batch.column(0).to_numpy())
        yield best.batch(qids)

    truth = _best_of(placed.select("rep", "e").mapInArrow(exact, _PARTIAL), k + 1)
    truth = truth.where("q != v").join(placed.select(F.col("rep").alias("v"), "leaf"), "v").select("q", "leaf").toArrow()  # CALIBRATION * (k + 1) rows at most
    near = _distances(np.hstack([q, np.zeros((len(q), 1))]), tree.value.centres)
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.value.ranked(d.tolist(), leaves))} for i, d in zip(qids, near)}
    needed = np.sort([order[a][b] for a, b in zip(truth.column(0).to_pylist(), truth.column(1).to_pylist())])
    visits = 1
    while visits < leaves and np.searchsorted(needed, visits) < recall * len(needed):
        visits = min(leaves, visits + max(1, visits // 4))
    return visits

"""Document probability under a subword unigram model, summed over all segmentations.

The vocabulary is that of an existing tokenizer; the weight of each piece is learned from
the training documents of the whole table. Pieces never span words, so the probability of a
text is the product of its words' probabilities, and each distinct word is worked out once:
a forward recursion in log space over the word's lattice adds up every way to cut it.

No table of words is ever sent to all tasks. Documents are gathered into blocks, and a block
keeps its distinct words once and its documents as counts of those words. Distinct words of
all blocks meet by word, where training counts are summed and the lattice is run, and their
numbers go back to the blocks, which then score their documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrascope.session import cut_lineage

#: Text bytes in a block of documents.
BLOCK = 8 << 20
#: Documents whose hash has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Sign before the first piece of a word; added count of every piece; longest piece of a lattice in characters.
BEGIN, ADDED = "▁", 0.5

_BAGS = "block long, words array<binary>, train array<int>, doc_ids array<long>, has_id array<boolean>, held array<boolean>, sizes array<int>, at array<binary>, counts array<binary>, pieces array<int>, piece_counts array<long>, train_docs long"
_OUT = "doc_id long, held_out boolean, n_tokens long, known long, base double, lattice double"
#: Numbers per trie node, more than there are characters; characters walked together; rows gathered for it.
_FAN, _TOGETHER, _ROWS = 1 << 21, 1 << 18, 50_000
_LOADED: dict[str, "Pieces"] = {}


class Pieces:
    """The pieces of a vocabulary file with byte fallback, and its own segmentation for counting."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.number: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i in range(size):
            if self.model.is_byte(i):
                self.byte[int(self.model.id_to_piece(i)[3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.number[self.model.id_to_piece(i)] = i
        self.size = size
        self.end = self.model.eos_id() if self.model.eos_id() >= 0 else size
        self.longest = max(map(len, self.number))

    def count(self, words: list[str], weights: list[int]) -> Counter:
        """How often each piece occurs when the vocabulary's own merges cut the words."""
        total: Counter = Counter()
        for ids, weight in zip(self.model.encode(words, num_threads=1), weights):
            for i in ids:
                total[i] += weight
        return total


def _pieces(path: str | None) -> Pieces:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


class Lattice:
    """Log probabilities of words under given log weights of the pieces.

    The pieces form a trie, held as sorted numbers ``node * 2**21 + character``. Words of one
    length walk it together: from every place, all of them take one more character at a time
    until none of them is the start of a piece any more.
    """

    def __init__(self, pieces: Pieces, logs: np.ndarray) -> None:
        nodes: dict[tuple[int, int], int] = {}
        weights = [-np.inf]
        for piece, i in pieces.number.items():
            node = 0
            for c in piece:
                node = nodes.setdefault((node, ord(c)), len(weights))
                if node == len(weights):
                    weights.append(-np.inf)
            weights[node] = float(logs[i])
        keys = np.array([n * _FAN + c for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets, self.weights = keys[order], np.array(list(nodes.values()), np.int64)[order], np.array(weights)
        self.byte = [float(logs[pieces.byte[b]]) for b in range(256)]

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        found, at = np.unique(codes, return_inverse=True)
        return np.array([sum(self.byte[b] for b in chr(c).encode()) for c in found.tolist()])[at]

    def _one_length(self, words: list[str], n: int) -> np.ndarray:
        codes = np.frombuffer("".join(BEGIN + w for w in words).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(words), n + 1)
        reached = np.full((n + 2, len(words)), -np.inf)
        reached[0] = 0
        for i in range(n + 1):
            here, live, node = reached[i], np.arange(len(words)), np.zeros(len(words), np.int64)
            for j in range(i, n + 1):
                key = node * _FAN + codes[live, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                weight = np.where(known, self.weights[self.targets[at]], -np.inf)
                if j == i and (lone := weight == -np.inf).any():
                    weight[lone] = self._bytes(codes[lone, i])
                whole = weight > -np.inf
                rows = live[whole]
                reached[j + 1, rows] = np.logaddexp(reached[j + 1, rows], here[rows] + weight[whole])
                live, node = live[known], self.targets[at[known]]
                if not len(live):
                    break
        return reached[n + 1]

    def log_words(self, words: list[str]) -> np.ndarray:
        """Logs of the sums, over all segmentations, of the products of piece probabilities.

        A character that is no piece goes through its UTF-8 bytes.
        """
        out, sizes = np.empty(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1) if len(words) else ():
            n = int(sizes[group[0]])
            for part in np.array_split(group, len(group) * (n + 1) // _TOGETHER + 1):
                if len(part):
                    out[part] = self._one_length([words[i] for i in part], n)
        return out


def piece_logs(counts: np.ndarray, added: float = ADDED) -> np.ndarray:
    """Natural logs of the pieces' shares; every piece counts ``added`` more than it was seen."""
    return np.log((counts + added) / (counts.sum() + added * len(counts)))


def _bags(docs: DataFrame, path: str | None) -> DataFrame:
    """One row per block: its distinct words with training counts, its documents as word counts, its training pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        first, made = TaskContext.get().partitionId() << 32, 0
        number: dict[bytes, int] = {}
        train = np.zeros(1 << 16, np.int64)
        rows: list[tuple] = []
        held, trained = 0, 0

        def block() -> pa.RecordBatch:
            nonlocal number, rows, held, train, trained, made
            words = list(number)
            weights = train[: len(words)]
            seen = np.nonzero(weights)[0].tolist()
            count: Counter = Counter()
            for at in range(0, len(seen), 20_000):
                part = seen[at : at + 20_000]
                count.update(pieces.count([words[i].decode() for i in part], weights[part].tolist()))
            count[pieces.end] += trained
            columns = list(zip(*rows))
            values = [
                pa.array([first + made]), pa.array([words], pa.list_(pa.binary())), pa.array([weights.astype(np.int32)], pa.list_(pa.int32())),
                *[pa.array([list(c)], pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))],
                pa.array([list(count.keys())], pa.list_(pa.int32())), pa.array([list(count.values())], pa.list_(pa.int64())), pa.array([trained], pa.int64()),
            ]
            number, rows, held, trained, made = {}, [], 0, 0, made + 1
            train = np.zeros(1 << 16, np.int64)
            return pa.RecordBatch.from_arrays(values, [c.strip().split(" ")[0] for c in _BAGS.split(", ")])

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text, held_out in zip(ids, batch.column(1).cast(pa.binary()), out):
                words = (text.as_py() or b"").lower().split()
                counted = Counter(words)
                at = np.fromiter((number.setdefault(w, len(number)) for w in counted), np.int32, len(counted))
                count = np.fromiter(counted.values(), np.int32, len(counted))
                if len(number) > len(train):
                    train = np.concatenate([train, np.zeros(max(len(train), len(number)), np.int64)])
                if not held_out:
                    train[at] += count
                    trained += 1
                rows.append((doc_id or 0, doc_id is not None, held_out, len(words), at.tobytes(), count.tobytes()))
                held += len(text.as_py() or b"") + 64
                if held >= BLOCK:
                    yield block()
        if rows:
            yield block()

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"))
    return cut_lineage(rows.mapInArrow(gather, _BAGS), "bags")


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document.

    Null, empty and blank texts consist of the end token. A null id is never held out.
    Repeated rows count and are scored each time. An empty table gives no rows; other columns
    are ignored. Without training documents all counts are zero and all pieces weigh the same.
    """
    spark = docs.sparkSession
    bags = _bags(docs, path)
    pieces = _pieces(path)
    # At most one row per piece of the vocabulary.
    counted = bags.select(F.explode(F.arrays_zip("pieces", "piece_counts")).alias("p")).groupBy(F.col("p.pieces").alias("i")).agg(F.sum("p.piece_counts").alias("c")).toArrow()
    counts = np.zeros(max(pieces.size, pieces.end + 1))
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    logs = piece_logs(counts)
    weights = spark.sparkContext.broadcast(logs)  # one number per piece

    words = bags.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("pos", "w")).select(F.col("w.words").alias("word"), "block", "pos", F.col("w.train").alias("c"))
    by_word = Window.partitionBy("word")
    summed = words.withColumn("total", F.sum("c").over(by_word)).select("word", "block", "pos", "total")

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_pieces(path), weights.value)
        last, value = None, 0.0

        def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal last, value
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words = []
            new = np.zeros(rows.num_rows, bool)
            for i, word in enumerate(rows.column(0).to_pylist()):  # equal words come in a row
                if word != last:
                    last, new[i] = word, True
                    words.append(word.decode())
            found = np.r_[value, lattice.log_words(words)][np.cumsum(new)]
            value = float(found[-1])
            return pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(3), pa.array(found), pa.array(new)], ["block", "pos", "total", "lp", "new"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _ROWS:
                yield run(held)
                held = []
        if any(b.num_rows for b in held):
            yield run(held)

    numbers = cut_lineage(summed.mapInArrow(lattices, "block long, pos int, total long, lp double, new boolean"), "words")
    # Batches never split the words of a task over workers, so a word is new once.
    train_docs, train_words = bags.agg(F.sum("train_docs"), F.sum(F.aggregate("train", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    train_docs = train_docs or 0
    total = (train_words or 0) + train_docs
    distinct = numbers.where("new and total > 0").count() + (train_docs > 0)

    per_block = numbers.groupBy("block").agg(F.collect_list(F.struct("pos", "total", "lp")).alias("found"))
    joined = bags.select("block", "doc_ids", "has_id", "held", "sizes", "at", "counts").join(per_block, "block", "left")
    end = float(logs[pieces.end]) / math.log(10)
    ends = math.log10(train_docs + 1)
    rest = math.log10(total + distinct + 1)

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                found = row.column("found").flatten()
                pos = found.field("pos").to_numpy()
                c, lp = np.empty(len(pos)), np.empty(len(pos))
                c[pos], lp[pos] = found.field("total").to_numpy(), found.field("lp").to_numpy() / math.log(10)
                log_c = np.log10(c + 1)
                n_tokens, known, base, lattice = [], [], [], []
                sizes = row.column("sizes").flatten().to_pylist()
                for size, at, count in zip(sizes, row.column("at").flatten(), row.column("counts").flatten()):
                    at, count = np.frombuffer(at.as_py(), np.int32), np.frombuffer(count.as_py(), np.int32)
                    n_tokens.append(size + 1)
                    known.append(int(count[c[at] > 0].sum()) + (train_docs > 0))
                    base.append(float((log_c[at] * count).sum()) + ends - (size + 1) * rest)
                    lattice.append(float((lp[at] * count).sum()) + end)
                has = row.column("has_id").flatten()
                ids = pa.array([i if h else None for i, h in zip(row.column("doc_ids").flatten().to_pylist(), has.to_pylist())], pa.int64())
                values = [ids, row.column("held").flatten(), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lattice, pa.float64())]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "held_out", "n_tokens", "known", "base", "lattice"])

    out = joined.mapInArrow(total_up, _OUT)
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lattice").alias("score"))

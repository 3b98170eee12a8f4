"""Quality from weak labels: noisy heuristics, accuracies by EM, and a hashed linear scorer.

Eight heuristics vote good, bad or nothing on each document. How often each pattern of votes
occurs in the whole table is all that expectation-maximisation needs: it estimates the share
of good documents and, for each heuristic, how it votes on good and on bad ones, without any
label. The posterior of a pattern then labels a bounded sample of documents, on which a
logistic model over hashed words, word shapes and pairs of shapes is trained. That model
scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import hashed_sample

#: Documents that the scorer is trained on, at most; width of the hashed features; passes and step of the training.
TRAINED, WIDTH, PASSES, STEP, SHRINK = 6000, 1 << 15, 30, 0.5, 1e-4
#: Documents whose score reaches this are kept.
THRESHOLD = 0.3
ROUNDS, SETTLED = 200, 1e-9
GOOD, BAD, NONE = 2, 1, 0
VOTERS = ("symbols", "echo", "capitals", "function_words", "line_ends", "shouting", "repeated_lines", "word_length")
#: Frequent function words of the languages in the tables.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that was for on are as with by at be this an or from der die das und ist von den mit des im ein eine zu nicht auch"
    " le la les de des et est un une du que en pour dans sur par pas plus el los las y por con para del se una es no".encode().split()
)

_SYMBOLS, _CAPITALS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower()
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_REMEMBERED = 300_000
_OUT = "doc_id long, pattern int, posterior double, score double, kept boolean"


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on; the other way round if ``good`` is larger."""
    if good > bad:
        value, good, bad = -value, -good, -bad
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(text: bytes, words: list[bytes]) -> int:
    """All votes as one number in base 3; on texts of fewer than five words nobody votes."""
    n = len(words)
    if n < 5:
        return 0
    size = len(text)
    letters = size - len(text.translate(None, _LETTERS)) or 1
    lines = [x.rstrip() for x in text.split(b"\n") if x.strip()]
    lower = Counter(text.lower().split())
    found = [
        _vote((size - len(text.translate(None, _SYMBOLS))) / n, 0.05, 0.3),
        _vote(sum(a == b for a, b in zip(words, words[1:])) / n, 0.03, 0.15),
        _vote((size - len(text.translate(None, _CAPITALS))) / letters, 0.2, 0.5),
        _vote(sum(lower[w] for w in FUNCTION_WORDS) / n, 0.12, 0.04),
        _vote(sum(x.endswith((b".", b"!", b"?", b":", b'"', b")")) for x in lines) / len(lines), 0.8, 0.3),
        _vote(text.count(b"!!") / n, 0.01, 0.1),
        _vote(1 - len(set(lines)) / len(lines), 0.1, 0.3) if len(lines) > 3 else NONE,
        _vote(abs(len(b"".join(words)) / n - 6.5), 2.5, 5.5),
    ]
    return sum(v * 3**i for i, v in enumerate(found))


def _table(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(VOTERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """The share of good documents and ``P(vote | class)``, shaped voter, class (bad, good), vote; by EM.

    It starts from the belief that each heuristic knows one kind of flaw: a document with any
    bad vote is probably bad. Counts get half a vote more, so nothing is certain.
    """
    if not len(patterns):
        return 0.5, np.full((len(VOTERS), 2, 3), 1 / 3)
    votes_of = _table(patterns)
    good, bad = (votes_of == GOOD).sum(1), (votes_of == BAD).sum(1)
    weight = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    last, share, chance = -math.inf, 0.5, np.empty((len(VOTERS), 2, 3))
    for _ in range(ROUNDS):
        for k in range(len(VOTERS)):
            for v in range(3):
                at = votes_of[:, k] == v
                chance[k, 1, v] = 0.5 + (counts * weight)[at].sum()
                chance[k, 0, v] = 0.5 + (counts * (1 - weight))[at].sum()
        chance /= chance.sum(2, keepdims=True)
        share = float(np.clip((counts * weight).sum() / counts.sum(), 1e-6, 1 - 1e-6))
        logs = _logs(votes_of, share, chance)
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        weight = np.exp(logs[:, 1] - total)
        fit = float((counts * total).sum())
        if fit - last <= SETTLED * abs(fit):
            break
        last = fit
    return share, chance


def _logs(votes_of: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """Log weights of bad and good. A vote of nothing says nothing about the class."""
    logs = np.tile(np.log([1 - share, share]), (len(votes_of), 1))
    for k in range(chance.shape[0]):
        said = votes_of[:, k] != NONE
        logs[said] += np.log(chance[k][:, votes_of[said, k]]).T
    return logs


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """Chance that a document with these votes is good."""
    logs = _logs(_table(patterns), share, chance)
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


class Features:
    """Hashed words and shapes of a text, as numbers below ``WIDTH`` and weights of length one."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def _of(self, word: bytes) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            shape = word
            for pattern, sign in _SHAPES:
                shape = pattern.sub(sign, shape)
            got = xxhash.xxh3_64_intdigest(word.lower()) % WIDTH, xxhash.xxh3_64_intdigest(b"shape " + shape[:12])
            if len(self.known) < _REMEMBERED:
                self.known[word] = got
        return got

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        pairs = np.array([self._of(w) for w in words], np.uint64)
        shapes = pairs[:, 1]
        same = np.array([a == b for a, b in zip(words, words[1:])], np.uint64) + np.uint64(11)
        both = (shapes[:-1] * np.uint64(3) + shapes[1:]) % np.uint64(WIDTH)
        at = np.concatenate([pairs[:, 0], shapes % np.uint64(WIDTH), both, same]).astype(np.int64)
        index, count = np.unique(at, return_counts=True)
        value = np.log1p(count)
        return index, value / np.sqrt((value**2).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic model on soft targets, the bias last; adaptive steps over shuffled batches."""
    weights, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    rng = np.random.default_rng(11)
    # Both classes weigh the same.
    mass = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    weight = len(target) * (target / mass[0] + (1 - target) / mass[1]) / 2
    for _ in range(PASSES):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(at):
                continue
            index = np.concatenate([rows[i][0] for i in at])
            value = np.concatenate([rows[i][1] for i in at]).astype(np.float64)
            owner = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
            z = np.bincount(owner, weights[index] * value, len(at)) + weights[WIDTH]
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[at]) * weight[at]
            slope = np.bincount(index, error[owner] * value, WIDTH + 1) / len(at)
            slope[WIDTH] = error.mean()
            slope[:WIDTH] += SHRINK * weights[:WIDTH]
            seen += slope**2
            weights -= STEP * slope / np.sqrt(seen)
    return weights


def fit(docs: DataFrame, trained: int = TRAINED) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of good documents, the voters' chances, and the scorer's weights.

    Votes of all documents are counted; at most ``trained`` documents, taken by a hash of id and
    text, train the scorer on the driver. Only counts of vote patterns (at most 3 ** 8) and
    the features of that sample reach it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total[votes(text.as_py(), text.as_py().split())] += 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["pattern", "n"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            said, index, value = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                words = text.as_py().split()
                at, v = features.of(words)
                said.append(votes(text.as_py(), words)), index.append(at.astype(np.int32)), value.append(v.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.int32()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["pattern", "at", "value"])

    counted = texts.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    share, chance = estimate(counted.column(0).to_numpy(), counted.column(1).to_numpy())
    some = hashed_sample(texts, trained, int(counted.column(1).to_numpy().sum()), "doc_id", "text").select("text").repartition(16).mapInArrow(featured, "pattern int, at array<int>, value array<float>").toArrow()
    target = posterior(some.column(0).to_numpy(), share, chance) if len(some) else np.empty(0)
    return share, chance, train(_rows(some.column(1).combine_chunks(), some.column(2).combine_chunks()), target)


def _rows(index: pa.ListArray, value: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers and weights of every document as parts of two flat arrays; as objects they would take ten times the driver's memory."""
    ends = np.r_[0, np.cumsum(index.value_lengths().to_numpy())]
    flat = index.flatten().to_numpy(), value.flatten().to_numpy()
    return [(flat[0][a:b], flat[1][a:b]) for a, b in zip(ends, ends[1:])]


def score(docs: DataFrame, threshold: float = THRESHOLD, trained: int = TRAINED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, pattern, posterior, score, kept`` per document, after the columns named in ``keep``.

    Null, empty and blank texts score 0 and are not kept. Texts of fewer than five words get
    no votes, and the scorer alone decides. Equal texts score equally; an empty table gives no
    rows.
    """
    share, chance, weights = fit(docs, trained)
    model = docs.sparkSession.sparkContext.broadcast((share, chance, weights))  # WIDTH numbers
    kept = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, chance, weights = model.value
        features = Features()
        for batch in batches:
            said, scores = [], []
            for text in batch.column(len(keep) + 1).cast(pa.binary()):
                words = text.as_py().split()
                at, v = features.of(words)
                said.append(votes(text.as_py(), words))
                scores.append(1 / (1 + math.exp(-np.clip((weights[at] * v).sum() + weights[WIDTH], -50, 50))) if words else 0.0)
            arrays = [batch.column(i) for i in range(len(keep) + 1)]
            arrays += [pa.array(said, pa.int32()), pa.array(posterior(np.array(said, np.int64), share, chance)), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "doc_id" if "doc_id" not in keep else "_id", "pattern", "posterior", "score", "kept"])

    return kept.mapInArrow(run, ", ".join([*fields, _OUT if "doc_id" not in keep else _OUT.replace("doc_id", "_id")]))


def good_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that are kept, with their own columns alone."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    boxed = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    return score(boxed, keep=tuple(names.values()), **settings).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])

"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents are ordered by id in range partitions. Each task streams its range: it tokenizes,
fills a buffer of some hundred windows, and chooses the cuts of the buffer that minimise
padding plus a penalty for every cut inside a document. Cuts lie at document ends, at
sentence ends, and, within a sentence that is longer than ``GAP``, at fixed steps. The
cheapest way to reach a cut is a minimum over the cuts at most one window before it, which
a monotone queue holds ready. The last window of a buffer stays open and starts the next.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a full window; windows per buffer; penalties, in tokens of padding, of a cut inside
#: a document at a sentence end and elsewhere, and of a window that is not full; the longest
#: stretch without a place to cut.
WINDOW, BUFFERED, SENTENCE_CUT, HARD_CUT, SHORT, GAP = 2048, 128, 4, 24, 16, 128
#: The id that ends a document, and the text that the vocabulary holds as one special id.
END_ID, SPECIAL, SPECIAL_ID = 1, "<|endoftext|>", 50256
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SPACED = re.compile(r" \s")
_LOADED: dict[str, "Ids"] = {}


class _Chunks(dict):
    """Ids, as bytes, of a word with the space before it."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Ids:
    """Token ids of texts for one byte-level vocabulary file.

    The merges run in a second library that takes the same vocabulary as ranks. A space
    before a character that is not white space always starts a token, so such texts are
    put together from the ids of their words; others are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        self.encode = tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = _Chunks(self.encode)
        self.ends = np.zeros(max(vocabulary.values()) + 2, bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith((b".", b"!", b"?", b"\xe2\x80\xa6")) or b"\n" in token

    def _plain(self, text: str) -> bytes:
        if _SPACED.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *words = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.chunks.__getitem__, words))

    def of(self, text: str) -> np.ndarray:
        """Ids of the text, then the end id."""
        special = np.array([SPECIAL_ID], "<u4").tobytes()
        body = special.join(self._plain(part) for part in text.split(SPECIAL))
        return np.frombuffer(body + np.array([END_ID], "<u4").tobytes(), "<u4")


def _ids(path: str | None) -> Ids:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Places of the cheapest cuts, from the first place to the last.

    ``places`` ascend from 0 with steps of at most ``window``. A window costs what is missing
    from ``window``, nothing at a power of two, plus the penalty of the cut that ends it and
    ``SHORT`` unless the window is full.
    Ties go to the longest window.
    """
    n = len(places)
    at = np.full(int(places[-1]) + 1, -1, np.int64)
    at[places] = np.arange(n)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power <= window:
        reached = np.nonzero(places >= power)[0]
        back = at[places[reached] - power]
        for j, i in zip(reached[back >= 0].tolist(), back[back >= 0].tolist()):
            exact[j].append(i)
        power *= 2
    where, extra = places.tolist(), penalties.tolist()
    cost, origin = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        here = where[j]
        while where[queue[0][1]] < here - window:
            queue.popleft()
        best, source = queue[0]
        best += window - here
        if where[source] > here - window:
            best += SHORT
        for i in exact[j]:
            short = SHORT if where[i] > here - window else 0
            if cost[i] + short < best:
                best, source = cost[i] + short, i
        best += extra[j]
        cost[j], origin[j] = best, source
        reach = best + here
        while queue and queue[-1][0] > reach:
            queue.pop()
        queue.append((reach, j))
    cuts, j = [where[-1]], n - 1
    while j:
        j = origin[j]
        cuts.append(where[j])
    return cuts[::-1]


def _cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the buffer can be cut, and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1.0)
    penalty[1:][ends[ids]] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = 0
    if penalty[-1] < 0:
        penalty[-1] = HARD_CUT
    places = np.nonzero(penalty >= 0)[0]
    for a, b in zip(places[:-1][np.diff(places) > GAP].tolist(), places[1:][np.diff(places) > GAP].tolist()):
        penalty[a + GAP : b : GAP] = HARD_CUT
    places = np.nonzero(penalty >= 0)[0]
    return places, penalty[places]


class _Packer:
    """Pieces of one stream of documents; ``first`` is the id of its first sequence."""

    def __init__(self, window: int, ends: np.ndarray, first: int) -> None:
        self.window, self.ends, self.sequence = window, ends, first
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # id, tokens before the buffer's part, tokens in the buffer, all tokens
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        room = BUFFERED * self.window
        for at in range(0, len(ids), room):
            part = ids[at : at + room]
            self.ids.append(part)
            self.docs.append([doc_id, at, len(part), len(ids)])
            self.held += len(part)
            if self.held >= room:
                self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        whole = np.array([d[1] + d[2] == d[3] for d in self.docs])
        places, penalties = _cut_places(ids, ends[whole], self.ends)
        cuts = choose_cuts(places, penalties, self.window)
        if not last and len(cuts) > 2:
            cuts.pop()
        docs, d, used = self.docs, 0, 0
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                doc_id, before, held, total = docs[d]
                take = min(held - used, b - at)
                self.rows.append((doc_id, before + used, take, zlib.crc32(ids[at : at + take].tobytes()), total, self.sequence, at - a))
                at, used = at + take, used + take
                if used == held:
                    d, used = d + 1, 0
            self.sequence += 1
        rest = docs[d:]
        if used:
            rest[0] = [rest[0][0], rest[0][1] + used, rest[0][2] - used, rest[0][3]]
        self.ids, self.docs, self.held = [ids[cuts[-1] :].copy()], rest, len(ids) - cuts[-1]

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null text counts as empty and gives the end id alone. Documents follow one another by id
    (nulls first), equal ids by a hash of the text; repeated rows are packed each time. A
    document longer than a window continues in the next ones. An empty table gives no rows;
    other columns are ignored. Sequence ids hold the partition in their upper half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer_path)
        packer = _Packer(window, ids.ends, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, ids.of(text.as_py() or ""))
                if len(packer.rows) > 20_000:
                    yield packer.take()
        packer.flush(True)
        yield packer.take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _OUT)

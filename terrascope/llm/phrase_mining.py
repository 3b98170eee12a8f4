"""Collocations: phrases of two to five words, the best of each language by a best-first search.

A phrase's score is the lowest, over its cuts into a left and a right part, of
``scale * f(phrase) * n / (f(left) * f(right))``. As neither part is rarer than the phrase, no
phrase that starts or ends with a word ``w`` scores more than ``scale * n / f(w)``. So the words
are a frontier ordered by that bound, rarest first. A turn takes the next words of every open
language into the frontier and counts all phrases that start or end with one of them, a word
longer at a time, where the shorter part at that word was frequent. A language is settled once
its last wanted score lies above the bound of the next word, or no frequent word is left; ties
with the bound keep it open.

Texts become blocks of word numbers once. Phrases are counted as they lie in a block, and the
blocks' counts are added up. Which words and phrases are frequent travels as a bit table of
fixed size; a wrong bit costs some counting and no phrase is lost, as all decisions follow from
the added counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascope.session import cut_lineage

LONGEST = 5
AT_LEAST = 100
TOP = 2000
SCALE = 1000
UNKNOWN = "und"
#: Share of a language's word occurrences whose words the frontier holds after each turn, rarest first.
SHARES = (1 / 4, 1.0)
#: Bytes of text of one block, and bits of the tables of frequent words and phrases.
BLOCK = 3 << 20
TABLE_BITS = 26
_CHUNK_BITS = 15
#: Phrases of a block that become text at once.
_AT_ONCE = 50_000

# All characters that end a piece become the first of them, which then stands alone as a token.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_JOIN = bytes.maketrans(_ENDS, b"." * len(_ENDS))


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A to Z), and ``b"."`` wherever a piece ends."""
    # No other white space is left to split at.
    return text.lower().translate(_JOIN).replace(b".", b" . ").split()


# Fixed values of the 64-bit xxHash, which Spark's ``xxhash64`` follows.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hash_numbers(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's hash of one long value per place."""
    h = _turned((seed + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and that word's."""
    with np.errstate(over="ignore"):
        return _hash_numbers(word, _hash_numbers(h, np.uint64(42)))


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\t" + word, 42)


def _phrase_hash(lang: Column, phrase: Column) -> Column:
    """The same hashes in Spark."""
    words = F.transform(F.split(phrase, " "), lambda w: F.xxhash64(F.concat(lang, F.lit("\t"), w)))
    return F.reduce(F.slice(words, 2, LONGEST), F.element_at(words, 1), lambda h, w: F.xxhash64(h, w))


def bit_table(phrases: DataFrame) -> np.ndarray:
    """Bits set for every ``lang, phrase``; ``2 ** TABLE_BITS`` bits reach the driver, however many phrases there are."""
    place = F.pmod(_phrase_hash(F.col("lang"), F.col("phrase")), F.lit(1 << TABLE_BITS))
    chunks = phrases.select(F.shiftright(place, _CHUNK_BITS).alias("chunk"), (place % (1 << _CHUNK_BITS)).alias("bit"))
    rows = chunks.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    table = np.zeros((1 << (TABLE_BITS - _CHUNK_BITS), (1 << _CHUNK_BITS) // 8), np.uint8)
    for chunk, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        table[chunk] = np.frombuffer(bits, np.uint8)
    return table.reshape(-1)


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """Lists of (language, text) of about ``BLOCK`` bytes, whole texts."""
    block, size = [], 0
    for batch in batches:
        langs, texts = batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())
        for lang, text in zip(langs, texts):
            block.append((lang.as_py(), text.as_py()))
            size += len(block[-1][1]) + 1
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _counted(lang: list[bytes], phrase: list[bytes], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()).cast(pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        counts: dict[bytes, Counter] = {}
        for lang, text in block:
            counts.setdefault(lang, Counter()).update(tokens(text))
        for lang, seen in counts.items():
            seen.pop(b".", None)
            yield _counted([lang] * len(seen), list(seen), list(seen.values()))


class _Words(NamedTuple):
    """Words of a block by number, as flat columns that pass through Spark without an object per word; the first one is empty."""

    #: Languages of the block, and each word's number among them.
    langs: list[bytes]
    lang: np.ndarray
    #: All words one after the other, and where each starts and the last ends.
    text: bytes | pa.Buffer
    ends: np.ndarray
    hashes: np.ndarray


class _Codes(dict):
    """Codes of one language's words: 0 for a word that is not frequent and for the end of a piece.

    ``words`` holds the words of all codes with the number of their language and their hash.
    """

    def __init__(self, lang: bytes, number: int, frequent: np.ndarray, words: list[tuple[int, bytes, int]]):
        self.lang, self.number, self.frequent, self.words = lang, number, memoryview(frequent), words
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h = _word_hash(self.lang, word)
        place = h & ((1 << TABLE_BITS) - 1)
        code = 0
        if self.frequent[place >> 3] >> (place & 7) & 1:
            code = len(self.words)
            self.words.append((self.number, word, h))
        self[word] = code
        return code


def _coded(block: list[tuple[bytes, bytes]], frequent: np.ndarray) -> tuple[_Words, np.ndarray]:
    """Words that may be frequent, and all places of the block as numbers of them."""
    words: list[tuple[int, bytes, int]] = [(0, b"", 0)]
    coders: dict[bytes, _Codes] = {}
    parts = [np.zeros(1, np.int32)]
    for lang, text in block:
        coder = coders.get(lang) or coders.setdefault(lang, _Codes(lang, len(coders), frequent, words))
        found = tokens(text)
        parts += [np.fromiter(map(coder.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
    numbers, texts, hashes = zip(*words)
    ends = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return _Words(list(coders), np.array(numbers, np.int32), b"".join(texts), ends, np.array(hashes, np.uint64)), np.concatenate(parts)


def _ids(columns: Iterator[np.ndarray]) -> np.ndarray:
    """Numbers of the rows, equal for equal rows, from 0 in the order of their first; columns are taken one at a time."""
    ids = next(columns).astype(np.int64)
    for column in columns:
        ids = pd.factorize(ids * (int(column.max(initial=0)) + 1) + column)[0]
    return ids


def _block_phrases(words: _Words, codes: np.ndarray, longest: int, frequent: np.ndarray, taken: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of ``longest`` words that may be frequent and start or end with a word taken."""
    hashes = words.hashes
    open_end = _known(taken, hashes)
    open_end[0] = False
    open_end = open_end[codes]
    # Whether the phrase of the last length at a place may be frequent; single words are, if they have a code.
    good = word = codes > 0
    for size in range(2, longest + 1):
        count = len(codes) - size + 1
        if count <= 0:
            return
        first, last = open_end[:count], open_end[size - 1 :]
        fits = (first | last) & (good[:count] | ~first) & (good[1 : count + 1] | ~last)
        for j in range(size):
            fits &= word[j : j + count]
        at = np.flatnonzero(fits)
        if size < longest:
            h = hashes[codes[at]]
            for j in range(1, size):
                h = _longer(h, hashes[codes[at + j]])
            good = np.zeros(len(codes), bool)
            good[at] = _known(frequent, h)
    del good, word, fits, open_end, first, last
    ids = _ids(codes[at + j] for j in range(longest))
    many = np.bincount(ids)
    one = np.empty(len(many), np.int64)
    one[ids] = np.arange(len(ids))
    del ids
    langs = pa.array(words.langs, pa.binary()).cast(pa.string())
    texts = pa.StringArray.from_buffers(len(words.lang), pa.py_buffer(words.ends), pa.py_buffer(words.text))
    for k in range(0, len(one), _AT_ONCE):
        first = at[one[k : k + _AT_ONCE]]
        columns = [pa.array(codes[first + j]) for j in range(longest)]
        phrase = pc.binary_join_element_wise(*[texts.take(c) for c in columns], " ")
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.lang[codes[first]])), phrase, pa.array(many[k : k + _AT_ONCE], pa.int64())], ["lang", "phrase", "f"])


_OUT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
_COUNTED = "lang string, phrase string, f long"


def _sum(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


_BLOCKS = "langs array<string>, lang binary, text binary, ends binary, hashes binary, codes binary"
#: Rows of one batch on their way to Python and out of a file: of texts, and of blocks.
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
_TEXTS_AT_ONCE = 512


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run within hold so many rows of large values at a time; then the settings are put back."""
    usual = {key: spark.conf.get(key) for key in _BATCHES}
    try:
        for key in _BATCHES:
            spark.conf.set(key, str(rows))
        yield
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)


def _coded_blocks(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The blocks of the texts as numbers of their frequent words, written once; every later count reads these."""
    table = texts.sparkSession.sparkContext.broadcast(zlib.compress(frequent.data, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(table.value), np.uint8)
        for block in _blocks(batches):
            words, codes = _coded(block, known)
            langs = pa.array([words.langs], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            flat = {"lang": words.lang.tobytes(), "text": words.text, "ends": words.ends.tobytes(), "hashes": words.hashes.tobytes(), "codes": codes.tobytes()}
            yield pa.RecordBatch.from_arrays([langs, *(pa.array([x], pa.binary()) for x in flat.values())], ["langs", *flat])

    # A row group per block; else a file's blocks share a page, and a reader unpacks all of them at once.
    groups = {"parquet.block.size": str(BLOCK), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    with _batches(texts.sparkSession, _TEXTS_AT_ONCE):
        blocks = cut_lineage(texts.mapInArrow(run, _BLOCKS), "blocks", **groups)
    table.destroy()
    return blocks


def _phrases(blocks: DataFrame, longest: int, frequent: np.ndarray, taken: np.ndarray, at_least: int) -> DataFrame:
    """Written counts of the phrases of ``longest`` words that are frequent and may have an end taken."""
    # Two tables of 2 ** TABLE_BITS bits at most; they go once the counts are written.
    tables = blocks.sparkSession.sparkContext.broadcast([zlib.compress(t.data, 1) for t in (frequent, taken)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = [np.frombuffer(zlib.decompress(t), np.uint8) for t in tables.value]
        for batch in batches:
            for i in range(len(batch)):
                lang, text, ends, hashes, codes = (batch.column(c)[i].as_buffer() for c in range(1, 6))
                words = _Words(batch.column(0)[i].values.cast(pa.binary()).to_pylist(), np.frombuffer(lang, np.int32), text, np.frombuffer(ends, np.int32), np.frombuffer(hashes, np.uint64))
                yield from _block_phrases(words, np.frombuffer(codes, np.int32), longest, *unpacked)

    # A block is large, so a task holds one of them at a time. Few phrases are frequent: they go into as few files as their size asks for.
    with _batches(blocks.sparkSession, 1):
        counted = cut_lineage(_sum(blocks.mapInArrow(run, _COUNTED)).where(F.col("f") >= at_least).hint("rebalance"), f"phrases{longest}")
    tables.destroy()
    return counted


def _scored(phrases: DataFrame, words: DataFrame, reach: DataFrame, scale: int) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases with both ends within reach that no longer phrase explains.

    ``phrases`` hold every frequent phrase with an end within reach. A longer phrase that is as
    frequent has one among them that is a word longer, so those decide.
    """
    known = words.select("lang", "phrase", "f").union(phrases.select("lang", "phrase", "f"))
    split = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
    part = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    cuts = split.select("lang", "phrase", "a", "k", (F.size("_w") - 1).alias("cuts"), part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("_w") - F.col("k")).alias("_right"))
    found = cuts.join(known.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"]).join(known.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    found = found.join(reach.select("lang", "n", "top_f"), "lang")
    found = found.withColumn("score", _quotient(scale))
    best = found.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r", "n")).alias("s"),
        F.max(F.when(F.col("k") == 1, F.col("l") <= F.col("top_f"))).alias("_starts"), F.max(F.when(F.col("k") == F.col("cuts"), F.col("r") <= F.col("top_f"))).alias("_ends"),
    ).where("_starts and _ends")
    shorter = F.explode(F.array(F.regexp_replace("phrase", " [^ ]*$", ""), F.regexp_replace("phrase", "^[^ ]* ", "")))
    longer = phrases.where("size(split(phrase, ' ')) > 2").select("lang", shorter.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where("_longer is null or _longer < a")
    return left.select("lang", "phrase", "a", "s.l", "s.r", "s.n", "s.score")


def _quotient(scale: int) -> Column:
    """Whole part of ``scale * a * n / (l * r)``; the products have up to 38 digits."""
    return F.expr(f"cast({scale} as decimal(8,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def collocations(docs: DataFrame, at_least: int = AT_LEAST, top: int = TOP, scale: int = SCALE, longest: int = LONGEST, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and
    tabs; A to Z count as lower case. ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of
    the lowest-scoring cut, ``n`` all words of the language. Order: score, then ``a``, both falling, then
    phrase. A phrase within a longer one of at least its count does not appear. A null language is
    ``und``; null and empty texts have no words; repeated rows count each time; an empty table or
    one without frequent phrases gives no rows; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rare words are only needed for their language's total: they become one row, without a phrase.
    counted = _sum(texts.mapInArrow(_word_counts, _COUNTED)).withColumn("phrase", F.when(F.col("f") >= at_least, F.col("phrase")))
    with _batches(docs.sparkSession, _TEXTS_AT_ONCE):
        everything = cut_lineage(_sum(counted), "words")
    words = everything.where("phrase is not null")
    frequent = bit_table(words)
    blocks = _coded_blocks(texts, frequent)
    open_langs = everything.groupBy("lang").agg(F.sum("f").alias("n"))
    # Frequencies in rising order, with the share of their language up to each and the one that follows.
    rising = Window.partitionBy("lang").orderBy("f")
    steps = words.groupBy("lang", "f").agg((F.count(F.lit(1)) * F.col("f")).alias("mass"))
    steps = steps.select("lang", "f", F.sum("mass").over(rising).alias("mass"), F.lead("f").over(rising).alias("next_f"), (F.row_number().over(rising) == 1).alias("rarest"))
    steps = cut_lineage(steps, "steps")
    open_langs = cut_lineage(open_langs.withColumn("before", F.lit(0).cast("long")), "open")
    kept: list[DataFrame] = []
    phrases: list[DataFrame] = []
    for share in shares:
        within = steps.join(open_langs, "lang").where((F.col("mass") <= share * F.col("n")) | F.col("rarest"))
        reach = within.groupBy("lang", "n", "before").agg(F.max("f").alias("top_f"), F.max_by("next_f", "f").alias("next_f"))
        reach = cut_lineage(reach, "reach")
        taken = bit_table(words.join(reach, "lang").where("f > before and f <= top_f"))
        known = frequent.copy()
        for size in range(2, longest + 1):
            counted = _phrases(blocks, size, known, taken, at_least)
            if counted.isEmpty():
                break
            phrases.append(counted)
            known |= bit_table(counted)
        if not phrases:
            continue
        # A phrase counted in two turns has the same count in both.
        found = reduce(DataFrame.unionByName, phrases).join(reach, "lang", "left_semi").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = _scored(found, words, reach, scale).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        best = cut_lineage(best, "best")
        last = best.where(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        bound = F.expr(f"cast({scale} as decimal(8,0)) * cast(n as decimal(15,0)) div cast(next_f as decimal(19,0))")
        states = cut_lineage(reach.join(last, "lang", "left").withColumn("settled", F.coalesce(F.col("next_f").isNull() | (F.col("last") > bound), F.lit(False))), "states")
        kept.append(best.join(states.where("settled"), "lang", "left_semi"))
        open_langs = states.where("not settled").select("lang", "n", F.col("top_f").alias("before"))
        if open_langs.isEmpty():
            break
    if not kept:
        return texts.sparkSession.createDataFrame([], _OUT)
    return reduce(DataFrame.unionByName, kept).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

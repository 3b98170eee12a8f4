"""Phrases against a plain count of everything; the frontier ends early and loses nothing."""

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow.parquet as pq
import pytest

from terrascope.llm import phrase_mining as pm


def plain(rows, at_least, top, scale=pm.SCALE, longest=pm.LONGEST):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        explained = Counter()
        for phrase, a in f.items():
            for part in (phrase[1:], phrase[:-1]):
                explained[part] = max(explained[part], a)
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < at_least or explained[phrase] >= a:
                continue
            score, k = min((scale * a * n[lang] // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def check(spark, rows, at_least, top, **more):
    table = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f int").repartition(3)
    got = sorted(tuple(r) for r in pm.collocations(table, at_least=at_least, top=top, **more).collect())
    assert got == plain(rows, at_least, top)
    return got


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    set_phrases = ["alpha beta gamma", "one two three four five six", "x y x y x", "the end of days"]
    rows = []
    for i in range(150):
        said = [words[int(k)] for k in (rng.zipf(1.4, 60) - 1) % 60]
        for at in rng.integers(0, 60, 4):
            said[at] = set_phrases[int(rng.integers(0, 4))]
        rows.append((("en", "fr", None)[i % 3], "".join(w + str(rng.choice([" ", "  ", "\t", ". ", "\n", " "], p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.05])) for w in said)))
    return rows


@pytest.mark.parametrize("at_least, top", [(3, 7), (5, 2000)])
def test_equals_plain_count(spark, prose, at_least, top):
    assert check(spark, prose, at_least, top)


def test_small_blocks_and_tables(spark, prose, monkeypatch):
    """Counts add up over blocks, and a table full of wrong bits loses nothing."""
    full = np.full(1 << (pm.TABLE_BITS - 3), 0xFF, np.uint8)
    rows = [(b"en", (t or "").encode()) for _, t in prose]

    def counted(block):
        found = [b.to_pydict() for b in pm._block_phrases(*pm._coded(block, full), 3, full, full)]
        return Counter({p: f for b in found for p, f in zip(b["phrase"], b["f"])})

    assert sum((counted(rows[k : k + 20]) for k in range(0, len(rows), 20)), Counter()) == counted(rows)


def test_settles_before_the_whole_frontier(spark, monkeypatch):
    """With few phrases wanted the commonest words are never taken."""
    taken = []
    seen = pm.bit_table
    monkeypatch.setattr(pm, "bit_table", lambda df: taken.append({r.phrase for r in df.collect()}) or seen(df))
    rows = [("en", " ".join(f"c{i} d{i} c{i}" for i in range(9)) + ". " + ". ".join(f"p{i} q{i}" for i in range(6))) for _ in range(4)] + [("en", "c1 d1 " * 200)]
    check(spark, rows, 4, 2)
    assert not any("c1" in words for words in taken[1:])
    taken.clear()
    check(spark, rows, 4, 2000)
    assert any("c1" in words for words in taken[1:])


def test_ties_at_the_end(spark):
    """Phrases of equal score and count are ordered by their bytes and cut in that order."""
    rows = [("en", ". ".join(f"p{i} q{i}" for i in (3, 1, 2, 11, 10)) + ". é ü. Z z") for _ in range(4)]
    got = check(spark, rows, 4, 4)
    assert [r[2] for r in got] == ["p1 q1", "p10 q10", "p11 q11", "p2 q2"]


def test_large_numbers_are_exact(spark):
    row = spark.createDataFrame([(9_999_999_999_999, 9_999_999_999_998, 99_999_999, 99_999_989)], "a long, n long, l long, r long")
    r = row.select("*", pm._quotient(1000).alias("q")).first()
    assert r.q == 1000 * r.a * r.n // (r.l * r.r)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(tuple(r) for r in pm.collocations(odd, at_least=5).collect())
    assert got == plain([(r[2], r[1]) for r in odd_rows], 5, 2000) and got
    assert pm.collocations(empty).count() == 0
    assert pm.collocations(odd, at_least=10**9).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_hashes_are_those_of_spark(spark):
    keys = [("en", "a b"), ("", "é"), ("x\ty", "z" * 100), ("de", "ein zwei drei vier fünf")]
    table = pm.bit_table(spark.createDataFrame(keys, "lang string, phrase string"))
    hashes = []
    for lang, phrase in keys:
        words = [np.array([pm._word_hash(lang.encode(), w.encode())], np.uint64) for w in phrase.split(" ")]
        hashes.append(reduce(pm._longer, words)[0])
    assert pm._known(table, np.array(hashes)).all() and np.unpackbits(table).sum() == len(keys)


def test_counting_a_block_hashes_no_word_again(monkeypatch):
    """Words are hashed once, as the block is made; each of the counts reads flat columns."""
    full = np.full(1 << (pm.TABLE_BITS - 3), 0xFF, np.uint8)
    block = [(b"en", "Ab cé. ab cé ab".encode()), (b"de", "ab cé cé".encode()), (b"en", b"")]
    words, codes = pm._coded(block, full)
    texts = [words.text[a:b] for a, b in zip(words.ends, words.ends[1:])]
    assert [(words.langs[n], t) for n, t in zip(words.lang, texts)][1:] == [(b"en", b"ab"), (b"en", "cé".encode()), (b"de", b"ab"), (b"de", "cé".encode())]
    assert words.hashes[1:].tolist() == [pm._word_hash(words.langs[n], t) for n, t in zip(words.lang, texts)][1:]
    monkeypatch.setattr(pm, "_word_hash", None)
    found = {(r["lang"], r["phrase"]): r["f"] for b in pm._block_phrases(words, codes, 2, full, full) for r in b.to_pylist()}
    assert found == {("en", "ab cé"): 2, ("en", "cé ab"): 1, ("de", "ab cé"): 1, ("de", "cé cé"): 1}


def test_blocks_lie_in_row_groups_of_their_own(spark):
    """A reader unpacks one block at a time, not all blocks of a file; the settings are as before."""
    usual = [spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]
    texts = spark.range(0, 4, 1, 1).selectExpr("'en' as lang", f"array_join(transform(sequence(1, {pm.BLOCK // 5}), i -> concat('w', pmod(xxhash64(id, i), 5000))), ' ') as text")
    blocks = pm._coded_blocks(texts, np.full(1 << (pm.TABLE_BITS - 3), 0xFF, np.uint8))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [1] * 4
    assert usual == [spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]


def test_writes_what_is_frequent_in_few_files(spark, monkeypatch):
    """Rare words are not written, and frequent phrases do not lie in a file for each partition of the counts."""
    written = {}
    cut = pm.cut_lineage

    def spy(df, label="stage", **options):
        out = cut(df, label, **options)
        written.setdefault(label, (out.count(), len(out.inputFiles())))
        return out

    monkeypatch.setattr(pm, "cut_lineage", spy)
    rng = np.random.default_rng(3)
    said = [" ".join(f"w{k}" for k in rng.integers(0, 60, 60)) for _ in range(80)]
    rows = [("en", f"{text}. rare{i}. " + ". ".join(f"p{k} q{k}" for k in range(16))) for i, text in enumerate(said)]
    # Small partitions stand for large counts.
    small = {"coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1k", "advisoryPartitionSizeInBytes": "4k"}
    usual = {key: spark.conf.get(f"spark.sql.adaptive.{key}") for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(f"spark.sql.adaptive.{key}", value)
        check(spark, rows, 20, 2000, shares=(1.0,))
    finally:
        for key, value in usual.items():
            spark.conf.set(f"spark.sql.adaptive.{key}", value)
    assert written["words"][0] == 60 + 2 * 16 + 1
    assert written["phrases2"] == (16, 1)

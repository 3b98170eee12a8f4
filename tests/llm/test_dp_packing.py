"""Exact round trip of ids, and cuts against the full dynamic program."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrascope.llm import dp_packing as dp

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return WHOLE


ODD_TEXTS = [
    "", " ", "  ", "a ", " a", "a  b", "a   b c", "x \n y", "x\n\n y  \n", "tab\t tab", "it's we'll I'M", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "naïve 漢字 👍🏽 x", " nb sp　x", "a\r\nb \r c",
    "1234 5678,90 -- !!", "x" * 3000, "word " * 500, "...", " '", "' s",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_of_odd_texts(tokenizer, text):
    assert dp._ids(PATH).of(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sIl 1é漢.!\n\t\r |<>👍")), max_size=40))
def test_ids_of_any_text(text):
    assert dp._ids(PATH).of(text).tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]


def cost(cuts, penalty, window):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        size = b - a
        total += (0 if size & (size - 1) == 0 else window - size) + (dp.SHORT if size < window else 0) + penalty[b]
    return total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(12)
    for _ in range(60):
        window = 64
        places = np.cumsum(np.r_[0, rng.integers(1, 40, rng.integers(1, 60))])
        penalties = rng.choice([0.0, 4.0, 24.0], len(places))
        penalty = dict(zip(places.tolist(), penalties.tolist()))
        best = {0: 0.0}
        for j in places[1:].tolist():
            best[j] = min(best[i] + cost([i, j], penalty, window) for i in places.tolist() if j - window <= i < j)
        cuts = dp.choose_cuts(places, penalties, window)
        assert cuts[0] == 0 and cuts[-1] == places[-1] and cost(cuts, penalty, window) == pytest.approx(best[int(places[-1])])


def check_pieces(pieces, rows, tokenizer, window):
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    filled, covered = defaultdict(int), defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id] and p.length > 0
        filled[p.sequence_id] += p.length
        parts = {zlib.crc32(d[p.start : p.start + p.length].tobytes()) for d in ids[p.doc_id] if len(d) == p.doc_tokens}
        assert p.ids_crc32 in parts
        covered[p.doc_id] += p.length
    assert covered == {i: sum(map(len, d)) for i, d in ids.items()}
    assert max(filled.values()) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in filled.values()) / sum(filled.values())


def test_round_trip(spark, odd, odd_rows, empty, tokenizer):
    rows = [(r[0], r[1]) for r in odd_rows]
    check_pieces(dp.pack(odd).collect(), rows, tokenizer, dp.WINDOW)
    assert dp.pack(empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    padding = check_pieces(dp.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, dp.WINDOW)
    assert padding < 0.05


def test_documents_keep_their_order(spark):
    rows = [(i, f"Document {i} says little. " * (1 + i % 9)) for i in range(300)]
    pieces = dp.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order)

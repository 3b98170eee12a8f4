"""Base spans against Python's patterns, and which tokens the battery adds."""

import base64
import hashlib
import random
import re

import pytest

from terrascope.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16])


CASES = [
    "token: secret: abcdefghijklmnop", "Password = 'hunter2hunter2' and api_key=\"AAAABBBBCCCC\"", "passwd==abcdefghijkl=", "AKIAAKIA" + "X" * 12,
    "é漢 AKIA" + "Z9" * 8 + " deadbeefdeadbeef0 " * 3, "0123456789abcdef" * 400, "token=short", "TOKEN:" + "a" * 12 + "TOKEN:" + "b" * 12, "", None, "apikey : 'x' secret=" + "q" * 11,
]


def test_base_spans(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r for r in ss.find_secrets(rows).collect()}
    digests = {r.doc_id: r for r in ss.digests(ss.find_secrets(rows)).collect()}
    for i, text in enumerate(CASES):
        spans = base(text or "")
        assert [(s.start, s.kind, s.end) for s in got[i].base] == spans, text
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
        line = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert digests[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (digests[i].n_assign, digests[i].n_access, digests[i].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


@pytest.fixture(scope="module")
def mixed(spark):
    """Many long ordinary tokens, and random ones of several encodings."""
    random.seed(9)
    syllables = ["the", "ing", "ver", "ein", "keit", "tion", "and", "er", "heit", "lich", "es", "on"]
    ordinary = ["".join(random.choices(syllables, k=random.randint(7, 14))) for _ in range(4000)]
    ordinary += ["-".join(random.choices(["install", "guide", "section", "index", "page"], k=6)) for _ in range(1500)]
    secrets = [base64.b64encode(random.randbytes(n)).decode() for n in (33, 48, 66, 96) for _ in range(12)]
    secrets += ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=64)) for _ in range(12)]
    rows = [(i, f"see {t} there") for i, t in enumerate(ordinary + secrets)]
    return spark.createDataFrame(rows, "doc_id long, text string"), len(ordinary), len(secrets)


def test_battery_tells_random_from_ordinary(mixed):
    table, ordinary, secrets = mixed
    added = [r.doc_id for r in ss.find_secrets(table).collect() if any(s.kind == 3 for s in r.spans)]
    false = sum(i < ordinary for i in added)
    assert len(added) - false >= 0.7 * secrets
    assert false <= max(2, 0.05 * len(added))


@pytest.mark.parametrize("text", ["{}", "see {} there", "It was a long day and nobody wrote {} into the book, as far as we know."])
def test_more_random_tokens_than_ordinary_ones(spark, text):
    """Random tokens are found however many there are; ordinary ones beside them are not."""
    random.seed(5)
    syllables = ["the", "ing", "ver", "ein", "keit", "tion", "and", "er", "heit", "lich", "es", "on"]
    ordinary = ["".join(random.choices(syllables, k=random.randint(9, 14))) for _ in range(34)]
    ordinary += ["".join(w.title() for w in random.choices(["install", "guide", "section", "index", "page"], k=7)) for _ in range(34)]
    secrets = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40)) for _ in range(1000)]
    table = spark.createDataFrame([(i, text.format(t)) for i, t in enumerate(ordinary + secrets)], "doc_id long, text string")
    added = [r.doc_id for r in ss.find_secrets(table).collect() if any(s.kind == 3 for s in r.spans)]
    false = sum(i < len(ordinary) for i in added)
    assert len(added) - false >= 0.95 * len(secrets)
    assert false <= 0.02 * len(added)


def test_tokens_after_signs(spark):
    random.seed(4)
    token = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=64))
    ways = ("PRIVATE_KEY={}", "AccountKey={};", "AWS_SECRET_ACCESS_KEY={}", "https://a.example/b?sig={}", "https://a.example/b?x=1&k={}&y=2", 'KEY="{}"', "KEY='{}'", "KEY= {}")
    texts = [(w, t, f"Here is a line of plain words, {w.format(t)} and it goes on.") for w in ways for t in (token(), token(), token())]
    got = {r.doc_id: r for r in ss.find_secrets(spark.createDataFrame([(i, x) for i, (_, _, x) in enumerate(texts)], "doc_id long, text string")).collect()}
    for way in ways:
        found = [any(x[s.start : s.end] == t for s in got[i].spans) for i, (w, t, x) in enumerate(texts) if w == way]
        assert sum(found) >= 2, way


def test_masks(spark, odd, odd_rows, empty):
    text = 'ü token = "' + "ab12" * 10 + '" end deadbeefdeadbeef'
    out = ss.masked(spark.createDataFrame([(1, text, len(text)), (2, "plain", 5), (3, None, None)], "doc_id long, text string, n_chars long"))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == 'ü [SECRET]" end [SECRET]' and got[1].n_chars == len(got[1].text)
    assert got[2].text == "plain" and got[3].text is None
    same = ss.masked(odd)
    assert same.columns == odd.columns and same.count() == len(odd_rows)
    assert ss.masked(empty).count() == 0 and ss.find_secrets(empty).count() == 0


def test_plan_of_the_battery_stays_small(spark):
    """Statistics that enter one another many times are columns; written out, the plan had 224,645 characters."""
    tokens = spark.createDataFrame([(1, 0, 4, "a1b2c3d4e5f6", 6)], "row long, start int, end int, token string, encoding int")
    assert len(ss.battery(tokens)._jdf.queryExecution().executedPlan().toString()) < 30_000

"""Small tables with the odd cases that every corpus operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, grp string, spans string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids and sources, repeated rows, a very long text, clashing column names."""
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "lo") for b in ("n", "s", "r", "la", "ti")]
    text = lambda n, k: " ".join(words[(i * i * k + 7 * i + k) % 30] for i in range(n)) + "."
    rows = [(i, text(60 + i, 3 + i), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, None, "en", "s0"), (21, "", None, None), (22, " \t\n ", "de", "s1"), (23, "one", "en", None), (24, "one two", "en", "s2")]
    rows += [(None, text(70, 4), "en", "s0"), (None, None, None, None), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0")]
    rows += [(30, text(40_000, 11), "en", "s1"), (31, "überß é 漢字 " * 30 + "\n" + "x" * 5000, "de", "s2")]
    return [(i, t, lang, s, None if t is None else len(t), -1, "clash", "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

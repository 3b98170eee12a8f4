"""Trees, proofs and the climb against a plain Python manifest."""

import hashlib
import zlib
from itertools import groupby

import pytest

from terrascope.llm import merkle_manifest as mm

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def tree(nodes):
    built = [nodes]
    while len(built[-1]) > 1:
        built.append([digest(*built[-1][i : i + 2]) for i in range(0, len(built[-1]), 2)])
    return built


def siblings(built, i):
    for level in built[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""
        i >>= 1


def plain(rows):
    """The manifest's rows, for rows as dicts."""
    first = lambda v: (v is not None, v if v is not None else 0)
    lang = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    ordered = sorted(rows, key=lambda r: (lang(r), first(r["doc_id"]), leaf(r)))
    groups = [list(g) for _, g in groupby(ordered, key=lang)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for place, (group, built) in enumerate(zip(groups, trees)):
        for i, row in enumerate(group):
            way = [*siblings(built, i), *siblings(top, place)]
            hit = row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row | {"n_chars": row["n_chars"] + 1}) if hit else leaf(row)
            for right, other in way:
                node = digest(other, node) if right else digest(node, other)
            out.append((row["doc_id"], leaf(row), built[-1][0], top[-1][0], digest(*[s for _, s in way]), node, node == top[-1][0]))
    return sorted(out, key=str)


def check(df):
    got = sorted((tuple(r) for r in mm.manifest(df).collect()), key=str)
    assert got == plain([r.asDict() for r in df.collect()])
    return got


def test_odd_rows(odd):
    got = check(odd)
    assert {r[-1] for r in got} == {True, False}


def test_empty_table(empty):
    assert mm.manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [257, 5, 1], [1, 255, 256, 700]])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(1000 * t + 3 * i, f"text {t} {i}", None if t == 0 else f"l{t}", "s", i) for t, n in enumerate(sizes) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_links_over_runs_of_leaves(spark, monkeypatch):
    """Short links and runs: several hops in a tree, nodes repeated for the runs below them."""
    monkeypatch.setattr(mm, "SPAN", 2)
    monkeypatch.setattr(mm, "BLOCK_BITS", 3)
    rows = [(i, "t", f"l{0 if i < 90 else i}", None, None if i % 5 else i) for i in range(110)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))


def test_limit_of_the_session_stays(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(4)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "5"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")

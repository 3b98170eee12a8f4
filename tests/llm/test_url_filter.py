"""Parts and rules of URLs against a plain version, and what the model learns."""

import numpy as np
import pytest

from terrascope.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1", "https://a.example.org/en/12?x=/es/", "https://example.org/en/2", "http://org", "http://org/",
    "http://x.org?q=1", "http://x.com/fr/a://b/c", "http://com.de/de/", "http://shop.com/de/1#top", "http://notcom/de/", "http://x.com/DE/", "http://münchen.com/fr/ü?ü", "x://y://z/fr",
    "http://user@host.com:80/fr/1", "https://cheap-pills.example.net/en/5", "http://blog.ththan.example.net/en/7", "http://a.com/" + "long" * 50_000, "http://a\nb.com/fr/\n",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_parts_rules_and_verdicts(spark):
    rows = [(i, u, "<p>", 0.5) for i, u in enumerate(URLS)] + [(3, URLS[6], None, 0.1), (None, URLS[5], None, 0.1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chance double").repartition(3)
    got = uf.judge(pages).collect()
    assert len(got) == len(rows)
    urls = {(r[0], plain(r[1])): r[1] for r in rows}
    for r in got:
        (host, path, rule, verdict) = next(p for (i, p) in urls if i == r.page_id and p[:2] == (r.host, r.path))
        assert r.rule == rule and r.verdict == (verdict or ("allow" if r.chance >= uf.THRESHOLD else "block"))
    by_id = {r.page_id: r.verdict for r in got if r.rule is None}
    assert by_id[19] == "block" and by_id[20] == "allow"


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_longest_rule_wins_and_first_of_equals(spark):
    rules = (("a.b", "/x", "allow"), ("b", "/x/yz", "block"), ("b", "/x/yy", "allow"), ("b", "/x/yy", "block"))
    row = spark.createDataFrame([("a.b", "/x/yy")], "host string, path string")
    found = row.select(uf.longest_rule(row.host, row.path, rules).alias("r")).first().r
    assert (found.rule, found.verdict) == ("b/x/yy", "allow")


def test_runs_stay_in_their_text():
    """The places of a text do not depend on its neighbours, and host and path are told apart."""
    texts = ["abc", "", "x", "überlänge", "abc"]
    place, owner = uf.features(texts, 1)
    for i, text in enumerate(texts):
        alone, _ = uf.features([text], 1)
        assert sorted(place[owner == i]) == sorted(alone) and len(alone) == sum(max(0, len(text) + 2 - n + 1) for n in uf.SIZES)
    assert set(uf.features(["abc"], 1)[0]) != set(uf.features(["abc"], 2)[0])


def test_held_out_names(spark):
    """Names with a known part are told apart although the whole name is new; slices change nothing."""
    rows = uf.labelled()
    frame = spark.createDataFrame([*rows, (None, 1), ("http://unknown.com/", None)], "url string, allow int")
    weights = uf.train(frame)
    assert np.array_equal(weights, uf.train(frame.repartition(7)))
    bad, good = ["best-casino.com", "pills-4you.net", "adserver9.org"], ["river-news.com", "stathing.net", "old-museum.org"]
    chance = uf.chances(weights, bad + good, ["/"] * 6)
    assert (chance[:3] < 0.5).all() and (chance[3:] >= 0.5).all()
    assert uf.chances(weights, bad[:1], ["/"])[0] == pytest.approx(chance[0])


def test_cross_validated_accuracy():
    """Four fifths of the names train, the others are judged: no name is in both parts."""
    rows = uf.labelled()
    host = lambda u: u.split("://")[1].split("/")[0]
    name = np.array([max(host(u).replace("example", "").split("."), key=len) for u, _ in rows])
    allow = np.array([a for _, a in rows])
    names = sorted(set(name))
    right = 0
    for fold in range(5):
        out = np.isin(name, names[fold::5])
        train = [rows[i][0] for i in np.flatnonzero(~out)]
        w = uf.fit([host(u) for u in train], [""] * len(train), allow[~out])
        held = [rows[i][0] for i in np.flatnonzero(out)]
        right += ((uf.chances(w, [host(u) for u in held], [""] * len(held)) >= 0.5) == (allow[out] == 1)).sum()
    assert right / len(rows) >= 0.75

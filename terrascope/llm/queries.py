"""One registered query per corpus operator, with the statement that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrascope.llm import circulant_minhash, dp_packing, entropy_mix, kmeans_tree, lattice_score, license_spans, line_cleaning, merkle_manifest, phrase_mining, secret_scan, url_filter, warc_dictionary, weak_quality
from terrascope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None) -> Callable:
    def wrap(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[key] = run
        if check:
            CHECKS[key] = check
        return run

    return wrap


@query("op1_entropy_mix")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return entropy_mix.mix(table(spark, folder, "documents"))


OP2_CHECK = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
m as (select payload_digest, max(page_id) as last, count(*) as copies from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, d.payload_digest,
  case when copies > 1 and last <> page_id then 'revisit' else 'response' end as record_type,
  case when copies > 1 and last <> page_id then last end as refers_to
from d left join m on d.payload_digest = m.payload_digest and payload_bytes >= 1000
"""


@query("op2_warc_dictionary", OP2_CHECK)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    back = warc_dictionary.archive_and_read(table(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_secret_randomness")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, folder, "documents")))


@query("op4_kmeans_tree")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.search(table(spark, folder, "embeddings"))


@query("op5_lattice_score")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_score.score(table(spark, folder, "documents"))


@query("op6_license_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return license_spans.scan(table(spark, folder, "documents"))


@query("op7_weak_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality.score(table(spark, folder, "documents"))


def _op8_check() -> str:
    phrases = " or ".join(f"contains(lower(x), '{p}')" for p in line_cleaning._BOILERPLATE)
    short, word = line_cleaning.SHORT_LINE, "[^\\x20\\x09-\\x0D]+"
    ends = line_cleaning._ENDS.replace("'", "''")
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, t, regexp_extract_all(t, '{word}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as l from t),
p as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from m) z),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest([i, i + 1, i + 2]) as q from (select *, count(*) over (partition by doc_id, g) as c from p) z where c > 1) y group by doc_id),
x as (select doc_id, x, len(regexp_extract_all(x, '{word}')) as n, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) as chars,
    length(regexp_replace(x, '[^{line_cleaning._DIVIDERS}]', '', 'g')) as d from (select doc_id, unnest(l) as x from m) z),
f as (select doc_id, sum(chars) as lost from x where
    (not regexp_matches(right(rtrim(x), 12), '{ends}') and (n < {short} or not regexp_matches(x, '{line_cleaning._INSIDE}')))
    or (d >= {line_cleaning.SEPARATORS} and d * 4 >= n) or (n < {short} and regexp_matches(x, '{line_cleaning._NAVIGATION}')) or (n < {4 * short} and ({phrases})) group by doc_id),
b as (select m.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^{line_cleaning.SYMBOLS}]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(f.lost, 0) as lost from m left join r using (doc_id) left join f using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (lost > {line_cleaning.MOST_LOST} * word_chars) as kept from b"""


@query("op8_line_cleaning", _op8_check())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_cleaning.clean_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_dp_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return dp_packing.pack(table(spark, folder, "documents"))


OP10_CHECK = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from t),
u as (select doc_id, len(g) as n, unnest(g) as g from s),
c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from c where 100 * c.c >= 85 * (n + m - c.c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
k as (select a as doc_id, min(b) as component_id from r group by a)
select s.doc_id, len(g)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join k on s.doc_id = k.doc_id
"""


@query("op10_circulant_dedup", OP10_CHECK)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def _op11_check() -> str:
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda n: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    # crc32 bit by bit: each character is mixed in and followed by eight shifts, written as -1.
    bits = "flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: [ascii((doc_id::varchar)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295], {bits}), lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, 3988292384 * (x & 1)) end), 4294967295)"
    level = lambda t, below, key: f"""{t}(tree, level, pos, h, n) as (select * from {below}
      union all select {key}, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from {t} where n > 1 group by all)"""  # noqa: E731
    beside = lambda c, s: f"case when {c}.at % 2 = 1 then coalesce({s}.h, '') || {c}.h else {c}.h || coalesce({s}.h, '') end"
    climb = lambda t, start, nodes: f"""{t} as (select * from {start}
      union all select c.doc_id, c.tree, c.level + 1, c.at // 2, c.n, sha256({beside('c', 's')}), c.proof || coalesce(s.h, '')
      from {t} c left join {nodes} s on s.tree = c.tree and s.level = c.level and s.pos = xor(c.at, 1::bigint) where c.n > power(2, c.level))"""  # noqa: E731
    ends = lambda t: f"(select * from {t} where n <= power(2, level))"
    return f"""with recursive d as (select doc_id, coalesce('=' || lang, '') as tree, {leaf("n_chars")} as leaf,
    case when {crc} % 7 = 0 then {leaf("(n_chars + 1)")} else {leaf("n_chars")} end as climbs from documents),
p as (select *, row_number() over (partition by tree order by doc_id) - 1 as pos, count(*) over (partition by tree) as n from d),
low0 as (select tree, 0::bigint as level, pos, leaf as h, n from p), {level("low", "low0", "tree")},
sub as (select tree, h as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as trees from low where n = 1),
up0 as (select 0 as tree, 0::bigint as level, place as pos, subroot as h, trees as n from sub), {level("up", "up0", "tree")},
a0 as (select doc_id, tree, 0::bigint as level, pos as at, n, climbs as h, '' as proof from p), {climb("a", "a0", "low")},
b0 as (select doc_id, 0 as tree, 0::bigint as level, place as at, trees as n, h, proof from {ends("a")} z join sub using (tree)), {climb("b", "b0", "up")}
select p.doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from p join sub using (tree) join {ends("b")} e using (doc_id), (select h as root from up where n = 1) r"""


@query("op11_merkle_climb", _op11_check())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, folder, "documents"))


@query("op12_url_ngrams")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def _op13_check() -> str:
    size, least, top = phrase_mining.LONGEST, phrase_mining.AT_LEAST, phrase_mining.TOP
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest(range(1, {size + 1})) as m from w) y) z),
f as (select lang, m, phrase, string_split(phrase, ' ') as ws, count(*) as f from g group by all having count(*) >= {least}),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
c as (select lang, m, phrase, f as a, k, array_to_string(ws[1:k], ' ') as x, array_to_string(ws[k + 1:], ' ') as y from (select *, unnest(range(1, m)) as k from f where m > 1) z),
s as (select c.lang, c.m, c.phrase, a, k, l.f as l, r.f as r, n, ({phrase_mining.SCALE}::hugeint * a * n // (l.f::hugeint * r.f))::bigint as score
    from c join f l on l.lang = c.lang and l.phrase = x join f r on r.lang = c.lang and r.phrase = y join t on t.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
e as (select lang, unnest([array_to_string(ws[1:m - 1], ' '), array_to_string(ws[2:], ' ')]) as phrase, f from f where m > 2),
d as (select b.* from b left join (select lang, phrase, max(f) as f from e group by all) e on e.lang = b.lang and e.phrase = b.phrase where e.f is null or e.f < a)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from d) z where rank <= {top}"""


@query("op13_phrase_frontier", _op13_check())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, folder, "documents"))

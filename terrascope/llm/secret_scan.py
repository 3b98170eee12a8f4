"""Secret spans: fixed patterns, and tokens that a battery of randomness tests finds random.

All of it is built-in functions. Per token the battery infers an encoding and takes three
statistics: chi-squared of symbol counts against a uniform alphabet, runs above and below
the middle of the alphabet, and the correlation of neighbouring symbols. A token is taken
for a secret if

* the battery does not reject that it is random (three p-values, joined by Fisher's rule), and
* its symbol counts are too even for ordinary text: a p-value for "ordinary", whose expected
  chi-squared follows from the shares that the encoding's symbols have in ordinary text and
  from the token's length. The shares are counted in the table's texts without their candidates
  and base spans, so that secrets, however many, do not enter them; fixed shares of letters
  bound them, for tables whose texts hold little else than tokens or repeat one template. The
  second decision is made by false-discovery control (Benjamini-Hochberg) over all candidates of the table, within classes of encoding and
  length, so short tokens, which carry little evidence, need stronger evidence in effect.

Texts are scanned once. What later passes need, a few numbers per candidate, is written to
the shared folder. The step-up rule works on counts of p-values in fine bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrascope.llm.common import let
from terrascope.session import cut_lineage

#: The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Kinds in order.
KINDS = ("assign", "access", "hex", "random")
#: Least candidate length; chance of rejecting a random token; share of ordinary tokens among those added.
LEAST_TOKEN, REJECT, DISCOVERY = 20, 0.001, 0.01
#: Ends of the length classes, and bins per factor of ten of a p-value.
LENGTHS, BINS, FLOOR = (24, 32, 48, 96), 20, 12

#: A token may follow '=', as in KEY=value and ?sig=value; the other signs would let it start inside another one.
_TOKEN = rf"(?<![\p{{L}}\p{{N}}+/_-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+={{0,2}}(?![\p{{L}}\p{{N}}])"
#: Encodings from the smallest alphabet on: name, what a token must match, symbols in order.
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS), ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"), ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOW), ("upper", "^[A-Z]+$", _UP), ("base32", "^[A-Z2-7]+$", _UP + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOW), ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UP),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW), ("base64", "^[0-9A-Za-z+/]+$", _UP + _LOW + _DIGITS + "+/"), ("base64url", "^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_"),
)
#: Signs of all encodings; shares of the letters a to z in prose (mean of en, de, fr, es, in thousandths), of capitals, digits and other signs.
SIGNS = _LOW + _UP + _DIGITS + "+/-_"
LETTERS = (85, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 62, 19, 6, 67, 74, 68, 41, 12, 11, 2, 8, 5)
CAPITALS, NUMERALS, OTHERS = 0.05, 0.01, 0.005
#: Least share of the fixed excess that counts, whatever the table's texts hold.
LEAST_EXCESS = 0.5


def fixed_excess(alphabet: str) -> float:
    """By how much two signs of prose are more often equal than evenly drawn ones, in terms of the latter."""
    letter = [x / sum(LETTERS) for x in LETTERS]
    share = {s: (1 - CAPITALS - NUMERALS - OTHERS) * x for s, x in zip(_LOW, letter)} | {s: CAPITALS * x for s, x in zip(_UP, letter)}
    share |= dict.fromkeys(_DIGITS, NUMERALS / 10) | dict.fromkeys("+/-_", OTHERS / 4)
    return max(0.0, len(alphabet) * sum(share[s] ** 2 for s in alphabet) / sum(share[s] for s in alphabet) ** 2 - 1)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi_normal(x: Column, df: Column) -> Column:
    """Normal variable with the upper tail of chi-squared, by the cube-root form (Wilson and Hilferty)."""
    v = 2 / (9 * df)
    return (F.cbrt(x / df) - (1 - v)) / F.sqrt(v)


def placed(text: Column, pattern: str) -> Column:
    """Structs ``(start, match)`` of all leftmost matches that do not overlap; code points."""

    def place(matches: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        found = F.aggregate(
            F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("all")),
            lambda a, m: F.struct((a["at"] + m["gap"] + F.length(m["match"])).alias("at"), F.concat(a["all"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), m["match"].alias("match")))).alias("all")),
        )["all"]
        return F.when(F.size(matches) > 0, found).otherwise(F.array().cast("array<struct<start:int,match:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Structs ``(start, kind, end)`` of the fixed patterns, in order of kind; kinds by number."""
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE
    assign = F.filter(placed(text, ASSIGN), value)
    return F.concat(_spans(assign, 0), _spans(placed(text, ACCESS), 1), _spans(placed(text, HEX), 2))


def ordinary_signs(text: Column) -> Column:
    """Counts of ``SIGNS`` in ``text`` without candidates and base spans."""
    count = lambda rest: F.transform(F.split(F.lit(SIGNS), ""), lambda s: (F.octet_length(rest) - F.octet_length(F.replace(rest, s, F.lit("")))).cast("long"))
    return let(F.regexp_replace(text, f"{_TOKEN}|{ASSIGN}|{ACCESS}|{HEX}", " "), count)


def _encoding(token: Column) -> Column:
    """Number of the smallest encoding that holds all symbols, else null."""
    found = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        found = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(found)
    return found


def _symbols(encoding: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), encoding + 1)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds ``n, k, chi, p_random`` and the symbol counts to rows with ``token`` and ``encoding``."""
    alphabet = _symbols(F.col("encoding"))
    n, k = F.length("token"), F.length(alphabet)
    counts = F.transform(F.split(alphabet, ""), lambda s: F.length("token") - F.length(F.replace(F.col("token"), s, F.lit(""))))
    ranks = F.transform(F.split("token", ""), lambda s: F.instr(alphabet, s) - 1)
    rows = tokens.withColumns({"n": n, "k": k, "counts": counts, "ranks": ranks})
    squares = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * c)
    # Runs of symbols in the upper and the lower half of the alphabet.
    high = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + (2 * r >= F.col("k")).cast("int"))
    pairs = F.zip_with(F.slice("ranks", 1, F.col("n") - 1), F.slice("ranks", F.lit(2), F.col("n") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumns({"squares": squares, "high": high, "pairs": pairs})
    runs = 1 + F.aggregate("pairs", F.lit(0.0), lambda a, p: a + ((2 * p["a"] >= F.col("k")) != (2 * p["b"] >= F.col("k"))).cast("int"))
    mid = (F.col("k") - 1) / 2
    product = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - mid) * (p["b"] - mid))
    rows = rows.withColumns({"chi": F.col("squares") * F.col("k") / F.col("n") - F.col("n"), "runs": runs, "product": product})
    low = F.col("n") - F.col("high")
    both = 2 * F.col("high") * low
    spread = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1.0))
    z_runs = F.when(spread > 0, (F.col("runs") - both / F.col("n") - 1) / F.sqrt(spread)).otherwise(40.0)
    variance = (F.col("k") * F.col("k") - 1) / 12.0
    z_serial = F.col("product") / (variance * F.sqrt(F.col("n") - 1.0))
    two_sided = lambda z: F.greatest(2 * normal_tail(F.abs(z)), F.lit(1e-300))
    # Sparse counts: the chi-squared mean is k - 1 and its variance shrinks by (n - 1) / n.
    z_chi = (F.col("chi") - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1.0) / F.col("n"))
    # Every number below enters the next one many times; as columns they do not multiply in the plan.
    rows = rows.withColumns({"z_chi": z_chi, "z_runs": z_runs, "z_serial": z_serial})
    rows = rows.withColumns({"t_chi": F.greatest(normal_tail(F.col("z_chi")), F.lit(1e-300)), "t_runs": two_sided(F.col("z_runs")), "t_serial": two_sided(F.col("z_serial"))})
    rows = rows.withColumn("z_fisher", chi_normal(-2 * (F.log("t_chi") + F.log("t_runs") + F.log("t_serial")), F.lit(6.0)))
    rows = rows.withColumn("p_random", F.greatest(normal_tail(F.col("z_fisher")), F.lit(0.0)))
    return rows.drop("ranks", "pairs", "squares", "high", "runs", "product", "z_chi", "z_runs", "z_serial", "t_chi", "t_runs", "t_serial", "z_fisher")


def find_secrets(docs: DataFrame, discovery: float = DISCOVERY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base`` and ``spans``, arrays of ``(start, kind, end)`` by start, then kind.

    Null and empty texts have no spans. Repeated rows stay, a text that many documents share
    is scanned in each, an empty table gives no rows. ``keep`` names more columns to carry.
    Added tokens that lie within a base span are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = docs.select("doc_id", *keep, text.alias("_text")).withColumn("base", base_spans(F.col("_text"))).withColumn("tokens", placed(F.col("_text"), _TOKEN)).withColumn("signs", ordinary_signs(F.col("_text"))).drop("_text")
    outside = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["start"] + F.length(t["match"]) <= b["end"])))
    scanned = cut_lineage(scanned.select("doc_id", *keep, F.array_sort("base").alias("base"), outside.alias("tokens"), "signs").withColumn("row", F.monotonically_increasing_id()), "scanned")

    each = scanned.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.start", (F.col("t.start") + F.length("t.match")).alias("end"), F.regexp_replace("t.match", "=+$", "").alias("token"))
    each = each.withColumn("encoding", _encoding(F.col("token"))).where("encoding is not null")
    tested = cut_lineage(battery(each).drop("token"), "tested")
    # Ordinary text: the chance that two symbols of an encoding are equal.
    spell = lambda e: F.split(_symbols(e), "")
    sums = F.array(*[F.sum(F.get("signs", F.lit(i))) for i in range(len(SIGNS))])
    shares = scanned.agg(sums.alias("c")).select(F.explode(F.arrays_zip(F.split(F.lit(SIGNS), "").alias("symbol"), F.col("c"))).alias("s")).select("s.symbol", F.col("s.c").cast("double").alias("c"))
    alphabets = tested.sparkSession.range(len(ENCODINGS)).select(F.col("id").cast("int").alias("encoding"), F.explode(spell(F.col("id").cast("int"))).alias("symbol"))
    repeats = alphabets.join(shares, "symbol", "left").fillna(0.0, ["c"]).groupBy("encoding").agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("c"), F.count("*").alias("k"))
    fixed = F.element_at(F.array(*[F.lit(fixed_excess(a)) for _, _, a in ENCODINGS]), F.col("encoding") + 1)
    counted = F.when(F.col("c") > 0, F.col("k") * F.col("cc") / (F.col("c") * F.col("c")) - 1).otherwise(fixed)
    excess = repeats.select("encoding", F.least(fixed, F.greatest(counted, LEAST_EXCESS * fixed)).alias("excess"))
    rows = tested.join(F.broadcast(excess), "encoding")  # one row per encoding
    usual = (F.col("k") - 1) + (F.col("n") - 1) * F.col("excess")
    rows = rows.withColumn("z", (F.col("chi") - usual) / F.sqrt(2 * (F.col("k") - 1) + 4 * F.col("n") * F.col("excess")))
    length = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        length = F.when(F.col("n") < LENGTHS[i], F.lit(i)).otherwise(length)
    # A bin holds p-values up to 10 ** (-bin / BINS); a token that is not random counts as p = 1.
    p = F.when(F.col("p_random") >= REJECT, F.greatest(normal_tail(-F.col("z")), F.lit(10.0**-FLOOR))).otherwise(1.0)
    rows = rows.select("row", "start", "end", "encoding", length.alias("length"), F.floor(-F.log10(p) * BINS).cast("int").alias("bin"))
    bins = rows.groupBy("encoding", "length", "bin").agg(F.count("*").alias("c"))
    stratum = Window.partitionBy("encoding", "length")
    upward = stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    passed = bins.withColumns({"up_to": F.sum("c").over(upward), "m": F.sum("c").over(stratum)}).where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / BINS) <= discovery * F.col("up_to") / F.col("m")))
    limits = passed.groupBy("encoding", "length").agg(F.min("bin").alias("limit"))
    found = rows.join(F.broadcast(limits), ["encoding", "length"]).where("bin >= limit")  # at most one row per class
    added = found.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return scanned.join(added, "row", "left").select("doc_id", *keep, "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mask``; overlapping spans give one mask.

    Texts without spans stay as they are, also null ones. ``n_chars`` follows the text where
    the table has it.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    keyed = docs.select("doc_id", F.struct(*[F.col(c) for c in others]).alias("_doc"), "text")
    found = find_secrets(keyed, keep=("_doc",))

    def cover(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = F.aggregate(
            "spans", start,
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).alias("out"),
            ),
        )
        return F.concat(done["out"], F.substr(text, done["at"] + 1))

    text = F.col("_doc.text")
    rows = found.select("doc_id", "_doc", F.when(F.size("spans") > 0, cover(text)).otherwise(text).alias("_text"), (F.size("spans") > 0).alias("_hit"))
    columns = {c: F.col(f"_doc.{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_hit"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return rows.select(*[columns[c].alias(c) for c in docs.columns])

"""Judge URLs: rules on host and path first, then a logistic model of hashed character n-grams.

The model learns from a small table of labelled URLs. Runs of three to five characters of
host and path, told apart and hashed into ``2 ** BITS`` places, are its features. Training takes
at most ``most`` labelled rows, by hash, to the driver; judging runs where the pages lie, on all
characters of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ascii_lower, hashed_sample

BITS = 18
SIZES = (3, 4, 5)
STEPS, RATE, SHRINK = 1500, 4.0, 1e-4
THRESHOLD = 0.5
#: Share of URLs that are expected to be allowed: what the labelled rows of both kinds weigh together.
ALLOWED = 0.75
#: At most so many labelled rows train the model.
MOST = 50_000
#: Characters of URLs that are worked on at once.
_AT_ONCE = 1 << 20

#: (host, path, verdict): a rule holds for the host and all hosts below it, on paths that start with its own.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# Parts of names that tell, and parts that stand beside either kind.
_BLOCK = (
    "casino pills viagra poker slots bets adult xxx porn ads adserver tracker track popup banner phish malware spam "
    "payday replica warez torrent roulette lottery pharmacy escort jackpot cams singles clickbait"
).split()
_ALLOW = (
    "news library science garden cooking museum school travel docs history weather paper music health chess birds code maths film radio "
    "thermal theory tension station thing thread other reason theatre northern"
).split()
_BESIDE = "win free king online best daily farm shop city club house world local plus one".split()
_HEADS, _ENDS = ("", "www.", "blog.", "m."), ("com", "net", "org", "info")
_PATHS = ("/", "/en/204", "/de/77.html", "/fr/8120/", "/es/345?page=2&ref=x", "/index.html", "/en/9051#top", "/2019/05/article")


def labelled() -> list[tuple[str, int]]:
    """The small table of labelled URLs, 1 to allow: each telling part alone and with three others, on hosts of all forms."""
    rows = []
    for allow, parts in ((0, _BLOCK), (1, _ALLOW)):
        for i, part in enumerate(parts):
            a, b, c = (_BESIDE[(i * 7 + k) % len(_BESIDE)] for k in (0, 4, 9))
            for j, name in enumerate((part, f"{a}-{part}", f"{part}-{b}", f"{part}{c}")):
                host = f"{_HEADS[(i + j) % 4]}{name}.{'example.' if j % 2 else ''}{_ENDS[(i // 2 + j) % 4]}"
                rows.append((f"{'https' if j else 'http'}://{host}{_PATHS[(i + 2 * j) % 8]}", allow))
    return rows


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``, null if none fits; of equally long ones the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1]), reverse=True)[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one 0 around each, and the text that each belongs to."""
    rows = [np.frombuffer(f"\0{t}\0".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.empty(0, np.uint32)).astype(np.uint64), np.repeat(np.arange(len(texts)), sizes)


def features(texts: Sequence[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all runs of characters, and the text of each run; a run holds a text's end as 0 but never two texts."""
    codes, owner = _codes(texts)
    places, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            count = len(codes) - n + 1
            if count <= 0:
                continue
            h = np.full(count, salt * 7 + n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[:count] == owner[n - 1 :]
            places.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[:count][inside])
    return (np.concatenate(places), np.concatenate(owners)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


def _rows(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, owners and weights: the runs of a URL's host together weigh one, and those of its path."""
    places, owners, weights = [], [], []
    for salt, texts in ((1, hosts), (2, paths)):
        place, owner = features(texts, salt)
        many = np.bincount(owner, minlength=len(texts))
        places.append(place), owners.append(owner), weights.append(1 / np.sqrt(many[owner]))
    return np.concatenate(places), np.concatenate(owners), np.concatenate(weights)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(hosts: Sequence[str], paths: Sequence[str], allow: np.ndarray) -> np.ndarray:
    """Weights by full-gradient steps, the bias last."""
    weights = np.zeros((1 << BITS) + 1)
    if not len(allow):
        return weights
    place, owner, value = _rows(hosts, paths)
    used, at = np.unique(place, return_inverse=True)
    share = np.where(allow == 1, ALLOWED / max((allow == 1).sum(), 1), (1 - ALLOWED) / max((allow == 0).sum(), 1))
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(STEPS):
        error = (_logistic(np.bincount(owner, w[at] * value, len(allow)) + bias) - allow) * share
        w -= RATE * (np.bincount(at, error[owner] * value, len(used)) + SHRINK * w)
        bias -= RATE * error.sum()
    weights[used], weights[-1] = w, bias
    return weights


def chances(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Chance to be allowed per URL, in slices of about a million characters."""
    out, start, size = np.empty(len(hosts)), 0, 0
    for i in range(len(hosts)):
        size += len(hosts[i]) + len(paths[i])
        if size >= _AT_ONCE or i + 1 == len(hosts):
            place, owner, value = _rows(hosts[start : i + 1], paths[start : i + 1])
            out[start : i + 1] = _logistic(np.bincount(owner, weights[place] * value, i + 1 - start) + weights[-1])
            start, size = i + 1, 0
    return out


def _texts(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def train(rows: DataFrame, most: int = MOST) -> np.ndarray:
    """Model of a table ``url, allow`` (1 or 0; other values and null URLs do not count), of at most ``most`` rows."""
    known = rows.where("url is not null and allow in (0, 1)").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("allow").cast("int").alias("allow"))
    some = hashed_sample(known, most, known.count(), "host", "path", "allow").toArrow()
    return fit(_texts(some.column(0).combine_chunks()), _texts(some.column(1).combine_chunks()), some.column(2).to_numpy())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, chance`` per page; ``labels``: table ``url, allow``.

    A null URL, an empty one and one without ``://`` have empty host and path; no rule fits them
    and the model judges what is left. Repeated rows are judged alike, whole URLs count however long,
    other columns are not read, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    labels = labels if labels is not None else spark.createDataFrame(labelled(), "url string, allow int")
    model = spark.sparkContext.broadcast(train(labels))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = chances(model.value, _texts(batch.column("host")), _texts(batch.column("path")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], [*batch.schema.names, "chance"])

    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = parts.mapInArrow(run, "page_id long, host string, path string, chance double").withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("chance") >= threshold, "allow").otherwise("block")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", verdict).alias("verdict"), "chance")

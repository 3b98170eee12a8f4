"""Line-first cleaning: drop lines that fail rules, then documents that lose too much text.

Everything is one pass of built-in functions over each row; nothing is shuffled. Measures of
the whole text that the base rules need are taken in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import WORD, bare, let, word_count, words_of

#: Words of a line below which it must end a sentence; separators that make a line navigation.
SHORT_LINE, SEPARATORS = 10, 3
#: Largest share of a document's word characters that its failed lines may hold.
MOST_LOST = 0.5
#: Symbols counted, base limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_ENDS = r"[.!?:;…。！？][\"'’”»)\]*_]*$"
_INSIDE = r"[.!?…。]\s"
_NAVIGATION = r"(?i)^\s*(home|menu|next|previous|back to top|skip to content|log ?in|sign (in|up)|site ?map|contact( us)?|about( us)?|search)\b"
_BOILERPLATE = (
    "all rights reserved", "cookie policy", "cookie settings", "cookies policy", "terms of use", "terms of service", "privacy policy", "enable javascript",
    "click here", "subscribe to our", "share this", "share on", "lorem ipsum", "powered by", "copyright (c)", "copyright ©",
)
_DIVIDERS = "|›»•·"


def _holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def _without(text: Column, symbols: str) -> Column:
    for c in symbols:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def line_fails(line: Column, n_words: Column, stock: Column) -> Column:
    """Whether one line with words fails: no sentence end, navigation, or boilerplate.

    A long line is excused from the punctuation rule if a sentence ends somewhere in it.
    ``stock`` tells whether the text of the line holds any stock phrase at all.
    """
    dividers = F.length(line) - F.length(_without(line, _DIVIDERS))
    no_end = ~F.right(F.rtrim(line), F.lit(12)).rlike(_ENDS) & ((n_words < SHORT_LINE) | ~line.rlike(_INSIDE))
    menu = (dividers >= SEPARATORS) & (dividers * 4 >= n_words)
    phrase = stock & (n_words < 4 * SHORT_LINE) & _holds_any(F.lower(line), _BOILERPLATE)
    return no_end | menu | ((n_words < SHORT_LINE) & line.rlike(_NAVIGATION)) | phrase


def _covered(words: Column) -> Column:
    """Words within windows of three that occur twice or more in ``words``.

    Windows are 64-bit hashes. Only texts with an equal pair are sorted; there, equal
    neighbours give the repeated starts, and each start adds what the previous one left open.
    """

    def starts(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def repeated(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.array_sort(F.array_compact(same))

        return let(F.sort_array(placed), repeated)

    def count(at: Column) -> Column:
        # A start covers three words, or as many as lie before the next start.
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(starts(windows), count))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def measures(text: Column) -> Column:
    """A struct of the base measures of ``text``; all are zero for text without words."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD[:-1]))
        dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(bare(t)).cast("long").alias("word_chars"),
                (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
                dup.cast("long").alias("n_dup_lines"), _covered(w).alias("n_repeat_words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def cleaned(text: Column) -> Column:
    """A struct of the text without failed lines, and the word characters kept and lost."""

    def of(t: Column) -> Column:
        judge = lambda stock: F.transform(
            F.split(t, "\n", -1), lambda x: let(word_count(x), lambda n: F.struct(x.alias("line"), F.length(bare(x)).alias("chars"), ((n > 0) & line_fails(x, n, stock)).alias("bad")))
        )
        judged = let(_holds_any(F.lower(t), _BOILERPLATE), judge)

        def parts(j: Column) -> Column:
            total = lambda keep: F.aggregate(F.filter(j, keep), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
            return F.struct(
                F.array_join(F.transform(F.filter(j, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("text"),
                total(lambda x: ~x["bad"]).alias("kept_chars"), total(lambda x: x["bad"]).alias("lost_chars"), F.size(F.filter(j, lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
            )

        return let(judged, parts)

    return let(F.coalesce(text, F.lit("")), of)


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept``, the clean text and what was lost.

    A document without words (null, empty or blank text) fails the base rules. Repeated rows
    and null ids stay as they are, an empty table gives no rows, other columns are ignored.
    A line that occurs in many documents is judged by itself in each of them.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", measures(F.col("text")).alias("m"), cleaned(F.col("text")).alias("c"))
    failed = (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > REPEAT_PERCENT * F.col("m.n_words"))
    lost = F.col("c.lost_chars") > most_lost * F.col("m.word_chars")
    return rows.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), (~failed & ~lost).alias("kept"),
        F.col("c.text").alias("clean_text"), F.col("c.kept_chars"), F.col("c.lost_chars"), F.col("c.n_bad_lines"),
    )

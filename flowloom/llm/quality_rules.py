"""Quality rules, lines first: rules drop lines, then documents that lose too much text are rejected.

Each line with a word is judged by four rules, in this order: ``boilerplate`` (a notice that pages repeat),
``navigation`` (a row of menu or table cells), ``noise`` (words that carry runs of symbols or exclamation marks),
``punctuation`` (no sentence ends at the end of the line). A line that fails any is removed. Measures of the whole
text as it was read come beside it; a text of too few words, or one made of repeated word triples, fails outright.

One pass over the rows with built-in functions only: no exchange, no Python. A row needs memory in proportion to its text:
its words, and its triples' hashes sorted. Triples are told apart by 64-bit hashes (in a text of a million words two unlike
ones agree with a chance of 3 in 10^8).

Null and empty texts have no words and no lines: all counts are 0 and the document is rejected as too short. Rows that
repeat an id are judged one by one, ties don't arise, an empty table gives no rows. Other columns pass through in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as in all contracts of this subpackage: blank and 0x09 to 0x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_STOP = r"(?=[\x20\x09-\x0D]|\z)"

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # % of words in repeated triples
MAX_LOST = 50  # % of the characters of lines with words
NOTICE_CHARS = 300  # a longer line is a paragraph, not a notice
LINE_ENDS = [*".!?…。！？\"')]}”’»"]
CELL_MARKS = [*"|»›•·"]
NOISE = ["###", "$$$", "%%%", "&&&", "***", "!!"]
BOILERPLATE = ["enable javascript", "javascript is disabled", "cookie policy", "accept cookies", "uses cookies", "privacy policy",
               "terms of use", "terms of service", "terms and conditions", "all rights reserved", "sign in to", "log in to",
               "subscribe to our", "click here", "read more", "share this", "back to top", "skip to content", "lorem ipsum"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def has_any(text: Column, marks: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(m) for m in marks])


def words_of(text: Column) -> Column:
    """Words in order; texts with no white space but blanks and line feeds take the quicker of two equal ways."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(has_any(text, [*"\t\x0b\x0c\r"]), F.split(text, _GAP)).otherwise(plain), "")


def _triples(words: Column) -> Column:
    """A 64-bit hash for each three words in a row."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(words, 3, n), lambda p, c: F.xxhash64(p, c))


def _covered_by_repeats(triples: Column) -> Column:
    """Number of words covered by triples that stand twice or more in the list."""
    def places(s: Column) -> Column:
        twice = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                           lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return _let(F.array_distinct(F.flatten(F.array_compact(twice))), lambda p: F.size(F.array_distinct(F.flatten(F.array(
            p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))))

    placed = F.arrays_zip(triples.alias("h"), F.sequence(F.lit(1), F.size(triples)).alias("i"))
    unlike = F.size(F.array_distinct(triples)) == F.size(triples)
    return F.when(unlike, 0).otherwise(_let(F.sort_array(placed), places)).cast("long")


def _failed_rule(line: Column, boilerplate: list[str]) -> Column:
    """Name of the first rule that a line fails; null if it passes."""
    n = F.regexp_count(line, F.lit(_WORD))
    cells = F.regexp_count(line, F.lit(rf"(?:\A|[\x20\x09-\x0D])[{''.join(CELL_MARKS)}]+{_STOP}"))
    noisy = F.regexp_count(line, F.lit(rf"(?:{'|'.join(re.escape(x) for x in NOISE)}){_STOP}"))
    notice = _let(F.lower(line), lambda x: has_any(x, boilerplate)) if boilerplate else F.lit(False)
    ended = lambda x: reduce(Column.__or__, [x.endswith(e) for e in LINE_ENDS])
    return (F.when((F.length(line) <= NOTICE_CHARS) & notice, "boilerplate")
            .when(has_any(line, CELL_MARKS) & (cells >= 2) & (cells * 4 >= n), "navigation")
            .when(has_any(line, NOISE) & (noisy >= 2) & (noisy * 3 >= n), "noise")
            .when(~ended(line) & ~ended(F.rtrim(line, F.lit(SPACE))), "punctuation"))


def clean_lines(docs: DataFrame, text: str = "text", boilerplate: list[str] | None = None, min_words: int = MIN_WORDS,
                max_repeated: int = MAX_REPEATED, max_lost: int = MAX_LOST) -> DataFrame:
    """``row`` (all columns of ``docs``), measures of the text, its lines' verdicts and ``kept``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` are of the text as read. ``removed`` has a map
    entry for each rule with the number of lines that failed it, ``cleaned`` the text without them (lines joined by a line feed),
    ``line_chars`` and ``lost_chars`` the code points of lines with a word and of those removed. ``base_failed`` is too few words
    or too many repeated ones; ``kept`` is false there and where over ``max_lost`` percent of ``line_chars`` are lost.
    """
    phrases = BOILERPLATE if boilerplate is None else boilerplate
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.select("row", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    judged = F.transform("lines", lambda x: F.struct(x.alias("line"), x.rlike(_WORD).alias("worded"), F.when(
        x.rlike(_WORD), _failed_rule(x, phrases)).alias("rule")))
    rows = rows.select("*", _triples(F.col("words")).alias("triples"))
    symbols = F.when(has_any(F.col("text"), [*SYMBOLS]), F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).otherwise(0)
    rows = rows.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        _covered_by_repeats(F.col("triples")).alias("n_repeat_words"), judged.alias("judged"))
    rows = rows.select(
        "*", F.filter("judged", lambda x: x["worded"])["line"].alias("worded"),
        F.filter("judged", lambda x: x["rule"].isNotNull()).alias("failed"),
        F.filter("judged", lambda x: x["rule"].isNull())["line"].alias("passed"))
    rules = ["boilerplate", "navigation", "noise", "punctuation"]
    removed = F.create_map(*[e for r in rules for e in (F.lit(r), F.size(F.filter(F.col("failed")["rule"], F.lit(r).__eq__)))])
    rows = rows.select(
        "row", "n_words", "word_chars", "n_symbols", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", removed.alias("removed"), F.concat_ws("\n", "passed").alias("cleaned"),
        F.length(F.array_join("worded", "")).cast("long").alias("line_chars"),
        F.length(F.array_join(F.col("failed")["line"], "")).cast("long").alias("lost_chars"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return rows.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("line_chars")))

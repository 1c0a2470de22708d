"""Counts and shares that describe the shape of a text, as column expressions only.

A text is read once: words and windows are bound by ``let``, so nothing is computed twice and nothing is shuffled.
Repeated word windows are found by sorting 64-bit hashes of the windows within the row, so the cost is n log n in the
words of the text. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, let

SYMBOLS = "#*$%&|<>"
WINDOW = 3


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def _count(text: Column, character: str) -> Column:
    """How often a character stands in a text."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


def _count_class(text: Column, characters: str) -> Column:
    """How often the ASCII characters of a regex class stand in a text."""
    return F.octet_length(F.regexp_replace(text, f"[^{characters}]++", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds at least twice, each word counted once."""

    def covered(positions: Column) -> Column:
        # a window covers its own word and the next two, as far as the next repeated window doesn't
        gaps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def by_sorting(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            again = F.filter(pairs, lambda e, i: (e["h"] == F.get(pairs, i - 1)["h"]) | (e["h"] == F.get(pairs, i + 1)["h"]))
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        return let(ordered, lambda pairs: let(positions(pairs), covered))

    def count(windows: Column) -> Column:
        unique = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unique, F.lit(0).cast("long")).otherwise(by_sorting(windows))

    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return let(windows, count)


def _repeat_counts(text: Column) -> Column:
    return let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        ),
    )


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))


#: Shape features, none of which knows labels, language, source or id.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "exclaim_share", "pipe_share", "digit_share",
    "comma_share", "repeat_share", "distinct_share", "dup_line_share", "line_words",
)


def with_counts(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id``, the columns ``also`` and the counts of each row of ``docs``: one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, text.alias("_text"))
    counts = F.struct(
        _repeat_counts(F.col("_text")).alias("_r"),
        _line_counts(F.col("_text")).alias("_l"),
        *[_count(F.col("_text"), character).alias(f"_n{k}") for k, character in enumerate(SYMBOLS + "!,")],
        _count_class(F.col("_text"), "A-Z").alias("n_upper"), _count_class(F.col("_text"), "0-9").alias("n_digit"),
    )
    # a generator of one row, through which no expression is substituted: each count is computed once however often it is used
    counted = slim.select("doc_id", *also, F.inline(F.array(counts)))
    by_symbol = [F.col(f"_n{k}") for k in range(len(SYMBOLS))]
    return counted.select(
        "doc_id", *also, "_r.*", "_l.*", reduce(add, by_symbol).alias("n_symbols"), by_symbol[SYMBOLS.index("|")].alias("n_pipe"),
        F.col(f"_n{len(SYMBOLS)}").alias("n_exclaim"), F.col(f"_n{len(SYMBOLS) + 1}").alias("n_comma"),
        "n_upper", "n_digit",
    )


def with_features(counts: DataFrame) -> DataFrame:
    """``counts`` with the shape features, all finite doubles; those of an empty text are 0."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    values = {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "pipe_share": share("n_pipe", "n_words"),
        "digit_share": share("n_digit", "word_chars"),
        "comma_share": share("n_comma", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "line_words": F.log1p(share("n_words", "n_lines")),
    }
    return counts.select("*", *[values[name].alias(name) for name in FEATURES])

"""Quality rules: a threshold table compiled into one projection.

Measures are Spark SQL expressions over the text; rules are rows of a table
(measure, comparison, threshold) that ``compile_rules`` turns into one boolean
column. No user functions take part.

Defined results: a null text counts as an empty one and fails the base rule;
ratios of empty texts are 0; repeated rows are judged one by one; columns other
than the text never matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "der", "die", "und", "das", "von", "zu", "le", "la", "de", "et", "les", "des", "que", "el", "los", "en", "y", "del", "un")


@dataclass(frozen=True)
class Rule:
    """A text passes if ``measure`` stays within the bounds (None: no bound)."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word, or per character where named so.
RULES = (
    Rule("symbols_per_word", most=0.3),
    Rule("mean_word_length", least=2.0, most=15.0),
    Rule("dup_line_ratio", most=0.6),
    Rule("stop_word_ratio", least=0.005),
    Rule("repeat_ratio", most=0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: bound as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are hashed and sorted with their positions; equal neighbours mark
    repeats; each marked window covers the words up to the next marked one.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(n < 4, F.lit(0)).otherwise(let(F.array_sort(hashed), marked))

    def marked(s: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return before | after

        return let(F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return let(words, windows).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The base counts of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.regexp_count(F.lower(text), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?![^\x20\x09-\x0D.,!?;:])")).cast("long"),
    }


def ratios() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "mean_word_length": F.col("word_chars") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "stop_word_ratio": F.col("n_stop_words") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
    }


def compile_rules(rules: tuple[Rule, ...], named: dict[str, Column]) -> Column:
    """One boolean column: every rule of the table holds."""
    tests = [F.lit(True)]
    for r in rules:
        if r.least is not None:
            tests.append(named[r.measure] >= r.least)
        if r.most is not None:
            tests.append(named[r.measure] <= r.most)
    return reduce(lambda a, b: a & b, tests)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``; an input column of such a name is replaced."""
    counted = docs.withColumns(measures(F.col(text_col)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules, ratios()))

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measure`` adds the counts of a text, ``verdict`` turns ``RULES`` into columns. Everything is a Spark expression;
no row leaves the JVM and nothing is shuffled.

Defined cases: a null or empty text has no words and all counts 0, so the base rule rejects it. Rows are judged
one by one, so repeated rows, ties and null ids keep their own result. Columns of the input are kept; a measured
column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    """the of and to in a is that it for on was with as be by this are or an
    der die und das von zu den mit ist des im für nicht ein eine dem sich auf
    le la les et est une un que qui dans pour par sur pas au du de en
    el los las y del se con una su lo como""".split()
)


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high``; a bound of None is open. A whole of 0 passes."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        sides = [part < whole * self.low] if self.low is not None else []
        sides += [part > whole * self.high] if self.high is not None else []
        broken = F.lit(False)
        for side in sides:
            broken = broken | side
        return (whole > 0) & broken


RULES: tuple[Rule, ...] = (
    Rule("word_length", "word_chars", "n_words", 150, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _kept_count(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more: equal windows are neighbours once sorted."""

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("gram"), i.alias("at"))

    def starts(ordered: Column) -> Column:
        def repeated(k: Column) -> Column:
            here = ordered[k]
            beside = [F.get(ordered, k + step)["gram"] == here["gram"] for step in (-1, 1)]
            return F.when(F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False)), here["at"])

        marked = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), repeated)
        return F.filter(marked, lambda at: at.isNotNull())

    def covered(at: Column) -> Column:
        return F.size(F.array_union(F.array_union(at, F.transform(at, lambda x: x + 1)), F.transform(at, lambda x: x + 2)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    found = _let(_let(F.sort_array(windows), starts), covered)
    return F.when(F.size(words) >= 3, found).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules speak of, one row for each row.

    Words and lines are bound inside the expressions that count them, so that these stay cheap wherever the optimiser
    moves them.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(filled, WHITE), lambda w: w != "")
    lines = F.filter(F.split(filled, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(own: Column) -> Column:
        stops = F.size(F.filter(own, lambda w: F.lower(w).isin(*STOP_WORDS)))
        counts = {"n_words": F.size(own), "n_stop_words": stops, "n_repeat_words": _repeated_words(own)}
        return F.struct(*(n.cast("long").alias(name) for name, n in counts.items()))

    def of_lines(own: Column) -> Column:
        counts = {"n_lines": F.size(own), "n_dup_lines": F.size(own) - F.size(F.array_distinct(own))}
        return F.struct(*(n.cast("long").alias(name) for name, n in counts.items()))

    counted = docs.withColumns({"_of_words": _let(words, of_words), "_of_lines": _let(lines, of_lines)})
    fields = {name: F.col("_of_words")[name] for name in ("n_words", "n_stop_words", "n_repeat_words")}
    fields |= {name: F.col("_of_lines")[name] for name in ("n_lines", "n_dup_lines")}
    fields |= {
        "word_chars": _kept_count(filled, WHITE),
        "n_symbols": _kept_count(filled, f"[^{SYMBOLS}]+"),
        "n_exclamations": _kept_count(filled, "[^!]+"),
    }
    return counted.withColumns(fields).drop("_of_words", "_of_lines")


def verdict(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``broken_rules`` (their names, in the order of the table) and ``kept``."""
    few = F.col("n_words") < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    names = F.concat_ws(",", *(F.when(rule.broken(), rule.name) for rule in rules))
    return measured.withColumns({"base_failed": few | repeats, "broken_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("broken_rules") == "")
    )


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    return verdict(measure(docs, text), rules)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    return judge(docs.select(F.col(text).alias("text"), F.struct("*").alias("_row")), "text", rules).filter("kept").select("_row.*")

"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over one row, so a rule set costs one
narrow pass and no shuffle. Defined results: a null text counts as empty; an
empty text has no words and fails ``min_words``; ratios are compared by cross
multiplication, so no denominator can be zero; every row is returned, repeated
rows and rows with a null id too; other columns are neither read nor returned
by ``judge``, and pass through ``kept_rows`` whatever their names are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmetrics.llm.common import free_name, let, words_of

WINDOW = 8
SYMBOL = "[#*$%&|<>]"
BLANK = "[\\x20\\x09-\\x0D]"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"

# Common function words of the languages the rules know. The measure
# counts how many different ones stand in the text as they are.
STOP_WORDS = (
    "the of and to in that is was for on with as by be at from it this are or "
    "der die das und in den von zu mit sich ist nicht ein eine als auch es im für dem "
    "le la les de des du et en un une que qui est pour dans sur au par pas plus "
    "el los las de que y en un una por con no para se del al lo como su"
).split()


class Rule(NamedTuple):
    """Holds while ``scale * measure`` is at most / at least ``bound * per``."""

    name: str
    measure: str
    sense: str  # "at_most" or "at_least"
    bound: int
    scale: int = 1
    per: str | None = None


RULES = (
    Rule("min_words", "n_words", "at_least", 20),
    Rule("repeated_windows", "n_repeat_words", "at_most", 30, 100, "n_words"),
    Rule("mean_word_low", "word_chars", "at_least", 2, 1, "n_words"),
    Rule("mean_word_high", "word_chars", "at_most", 15, 1, "n_words"),
    Rule("symbols", "n_symbols", "at_most", 10, 100, "n_words"),
    Rule("capitals", "n_upper", "at_most", 40, 100, "word_chars"),
    Rule("stop_words", "n_stop_words", "at_least", 2),
    Rule("duplicate_lines", "n_dup_lines", "at_most", 30, 100, "n_lines"),
    Rule("ellipsis_lines", "n_ellipsis_lines", "at_most", 30, 100, "n_lines"),
)
BASE_RULES = ("min_words", "repeated_windows")


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Window hashes are sorted with their positions, so equal ones are
    neighbours; texts without any repeat stop at the distinct count.
    """
    def joined(h: Column, step: int) -> Column:
        """Hashes of runs twice as long, from words or hashes; the last ones, cut short, are dropped below."""
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def windows(h: Column) -> Column:
        eight = let(let(joined(h, 1), lambda pairs: joined(pairs, 2)), lambda fours: joined(fours, 4))
        return F.slice(eight, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    def repeated(ordered: Column) -> Column:
        """Starts of the repeated windows, ascending."""
        key = lambda j: F.get(ordered, j)["h"]
        same = lambda a, b: F.coalesce(a == b, F.lit(False))
        found = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda j: same(key(j), key(j + 1)) | same(key(j), key(j - 1)),
        )
        return F.sort_array(F.transform(found, lambda j: F.get(ordered, j)["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(let(ordered, repeated), covered)
        )

    return let(let(words, windows), count).cast("long")


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(w, stops)).cast("long").alias("n_stop_words"),
        ),
    )
    by_lines = let(
        F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD_CHARACTER)),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda line: line.endswith("...") | line.endswith("…")))
            .cast("long")
            .alias("n_ellipsis_lines"),
        ),
    )
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        (F.length(whole) - count(BLANK)).alias("word_chars"),
        count(SYMBOL).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
    )


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_lines",
    "n_ellipsis_lines",
    "n_upper",
)


def _place(name: str) -> str:
    if name in ("n_words", "n_repeat_words", "n_stop_words"):
        return f"w.{name}"
    return f"l.{name}" if name in ("n_lines", "n_dup_lines", "n_ellipsis_lines") else name


def holds(rule: Rule, measure) -> Column:
    left = measure(rule.measure) * rule.scale
    right = measure(rule.per) * rule.bound if rule.per else F.lit(rule.bound)
    return left <= right if rule.sense == "at_most" else left >= right


def verdict(rules, measure) -> Column:
    """One boolean: every rule of the table holds."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & holds(rule, measure)
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, all measures, ``base_failed``, the rules that fail, ``kept``."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    flat = measured.select("doc_id", *[F.col(f"m.{_place(name)}").alias(name) for name in MEASURES])
    base = [r for r in RULES if r.name in BASE_RULES]
    failed = F.array_compact(F.array(*[F.when(~holds(r, F.col), F.lit(r.name)) for r in rules]))
    base_failed = ~verdict(base, F.col)
    return flat.withColumns(
        {
            "base_failed": base_failed,
            "failed_rules": failed,
            "kept": ~base_failed & verdict(rules, F.col),
        }
    )


def kept_rows(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows whose text passes every rule, with all their columns."""
    name = free_name(docs.columns, "measures")
    measured = docs.withColumn(name, measures(F.col(text_col)))
    return measured.where(verdict(rules, lambda m: F.col(f"{name}.{_place(m)}"))).drop(name)

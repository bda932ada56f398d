"""Quality rules: a threshold table compiled into one projection.

Every measure of a document is an expression over its own row, so a table is judged in
one scan without a shuffle, and nothing leaves the JVM.

Defined results for odd input: a null or empty text has no words, so all counts are 0 and
the base check fails. Null ids are kept as they are; repeated rows are judged one by one;
an empty table gives an empty table. Columns of the input other than ``doc_id`` and
``text`` pass through ``judge``, unless a measure of the same name replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .native import words

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "a", "this",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "sur", "par", "au",
    "der", "die", "das", "und", "ist", "zu", "den", "mit", "von", "im", "nicht", "ein", "sich", "auf", "des",
    "el", "los", "las", "y", "del", "se", "con", "para", "su", "al", "lo", "es",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [least, most]; it is asked only of texts of ``from_words`` words or more."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Length, symbol, stop-word and line limits. They are wide: ordinary prose of any of the
#: four languages lies well inside.
RULES = (
    Rule("length", "n_words", least=10),
    Rule("word_length", "mean_word_chars", least=1.5, most=20),
    Rule("symbols", "symbol_ratio", most=0.08),
    Rule("stop_words", "stop_ratio", least=0.05, from_words=50),
    Rule("lines", "dup_line_ratio", most=0.5, from_words=20),
    Rule("line_length", "words_per_line", least=1.5, from_words=100),
)
BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 10, 20


def compiled(rules: tuple[Rule, ...], measures: Column) -> Column:
    """The threshold table as one boolean expression over a struct of measures."""

    def holds(rule: Rule) -> Column:
        value = measures[rule.measure]
        parts = []
        if rule.least is not None:
            parts.append(value >= F.lit(float(rule.least)))
        if rule.most is not None:
            parts.append(value <= F.lit(float(rule.most)))
        inside = reduce(lambda a, b: a & b, parts, F.lit(True))
        return inside if not rule.from_words else (measures["n_words"] < rule.from_words) | inside

    return reduce(lambda a, b: a & b, map(holds, rules), F.lit(True))


def covered_by_repeats(tokens: Column, window: int = WINDOW) -> Column:
    """Words lying in windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only a text with repeats pays
    for sorting: its windows are ordered by hash, those equal to a neighbour give the
    repeated positions, and each position adds the words up to the next one, at most a
    window. All of it is linear or n log n in the length of the text.
    """
    n = F.size(tokens)

    def key(i: Column) -> Column:
        return F.xxhash64(*[F.element_at(tokens, i + j) for j in range(window)])

    def in_order(keys: Column) -> Column:
        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return let(F.array_sort(pairs), repeated)

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = F.transform(
            ordered,
            lambda e, i: F.when(
                ((i > 0) & (F.get(ordered, i - 1)["k"] == e["k"]))
                | ((i < last) & (F.get(ordered, i + 1)["k"] == e["k"])),
                e["i"],
            ),
        )
        return let(F.sort_array(F.array_compact(same)), span)

    def span(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(window)), F.lit(window))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    keys = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), key)).otherwise(
        F.array().cast("array<bigint>")
    )
    return let(
        keys,
        lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(in_order(k)),
    )


#: Columns that judging adds, in order.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "mean_word_chars",
    "symbol_ratio", "stop_ratio", "dup_line_ratio", "words_per_line", "base_failed", "kept",
)


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All measures and the verdict as one struct; each step binds what the next ones share."""

    def counts(p: Column) -> Column:
        ws, ls = p["ws"], p["ls"]
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(p["text"], "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            covered_by_repeats(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def ratios(c: Column) -> Column:
        n, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
        return F.struct(
            *[c[name].alias(name) for name in MEASURES[:7]],
            (c["word_chars"] / n).alias("mean_word_chars"),
            (c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1))).alias("symbol_ratio"),
            (c["n_stop_words"] / n).alias("stop_ratio"),
            (c["n_dup_lines"] / lines).alias("dup_line_ratio"),
            (c["n_words"] / lines).alias("words_per_line"),
            (
                (c["n_words"] < BASE_LEAST_WORDS) | (100 * c["n_repeat_words"] > BASE_REPEAT_PERCENT * c["n_words"])
            ).alias("base_failed"),
        )

    def verdict(m: Column) -> Column:
        passes = ~m["base_failed"] & compiled(rules, m)
        return F.struct(*[m[name].alias(name) for name in MEASURES[:-1]], passes.alias("kept"))

    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]"))
    parts = F.struct(words(text).alias("ws"), lines.alias("ls"), whole.alias("text"))
    return let(parts, lambda p: let(counts(p), lambda c: let(ratios(c), verdict)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input with its measures, ``base_failed`` and ``kept``."""
    staged = docs.withColumn("__judged", judged(F.col(text), rules))
    return staged.withColumns({name: F.col("__judged")[name] for name in MEASURES}).drop("__judged")


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only; the verdict is part of the filter."""
    return docs.filter(judged(F.col(text), rules)["kept"])

"""Text normalisation and comparison: accents, edit distance, token sets, names."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PERSON_TITLE_PREFIX, WS, WS_CHARS
from .binding import let, on_both
from .dates import strip
from .numbers import ColumnOrName, _c

_NON_ASCII = r"[^\x00-\x7f]"


def _char_class(chars, gap: int) -> str:
    """Regex class of few ranges that covers ``chars`` (none of them is ASCII).

    Close characters share a range, so the class may match more than ``chars``. It
    only decides which way a text takes, and a class of many members is slow.
    """
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer) for ``translate``: accented letters to their base letter.

    Derived from the Unicode data of the running interpreter. Characters past the
    end of ``to`` are the combining marks, which ``translate`` deletes. ``longer``
    maps the few characters whose base is more than one character; Hangul syllables
    are not listed, their parts follow from arithmetic.
    """
    source, target, marks, longer = [], [], [], {}
    for ch in _decomposable():
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"
        )
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
        elif len(base) > 1:
            longer[ch] = base
    return "".join(source + marks), "".join(target), longer


@lru_cache(maxsize=1)
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """Like ``_fold_table`` for compatibility decomposition reduced to ASCII."""
    source, target, longer = [], [], {}
    for ch in _decomposable():
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        elif plain:
            longer[ch] = plain
    return "".join(source), "".join(target), longer


@lru_cache(maxsize=1)
def _decomposable() -> list[str]:
    """Non-ASCII characters that decompose or are combining marks, Hangul aside."""
    return [
        ch
        for code in range(0x80, 0x110000)
        if not 0xAC00 <= code <= 0xD7A3 and not 0xD800 <= code <= 0xDFFF
        for ch in (chr(code),)
        if unicodedata.decomposition(ch) or unicodedata.category(ch) == "Mn"
    ]


def _expand(text: Column, longer: dict[str, str]) -> Column:
    """Replace single characters by several, through one constant map."""
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    return F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )


def _split_hangul(text: Column) -> Column:
    """Hangul syllables to their two or three letters (rare, so kept off the main path)."""

    def utf16(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def one(ch: Column) -> Column:
        index = F.ascii(ch) - 0xAC00
        tail = index % 28
        return F.when(
            index.between(0, 11171),
            F.concat(
                utf16(F.floor(index / 588) + 0x1100),
                utf16(F.floor((index % 588) / 28) + 0x1161),
                F.when(tail > 0, utf16((tail + 0x11A7).cast("bigint"))).otherwise(""),
            ),
        ).otherwise(ch)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def fold_accents(value: ColumnOrName) -> Column:
    """Drop accents: canonical decomposition without the combining marks."""
    source, target, longer = _fold_table()
    rare = _char_class([*longer, *map(chr, range(0xAC00, 0xD7A4))], 0x400)

    def fold(text: Column) -> Column:
        simple = F.translate(text, source, target)
        return (
            F.when(~text.rlike(_NON_ASCII), text)
            .when(text.rlike(rare), _split_hangul(_expand(simple, longer)))
            .otherwise(simple)
        )

    return let(_c(value), fold)


def _lower_folded(value: ColumnOrName) -> Column:
    text = F.lower(_c(value).cast("string"))
    text = F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return fold_accents(text)


def _or_empty(value: ColumnOrName) -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit(""))


def normalize_for_distance(value: ColumnOrName) -> Column:
    """Lower case, no accents, no blanks (space, tab, CR, LF) and none of ``. - _ '``."""
    return F.translate(_lower_folded(value), " \t\n\r.-_'", "")


def _similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .otherwise(1.0 - F.levenshtein(a, b) / longest)
    )


def levenshtein_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Edit distance of the normalised texts; a missing text counts as empty."""
    return on_both(_or_empty(a), _or_empty(b), normalize_for_distance, _distance)


def _distance(a: Column, b: Column) -> Column:
    """Edit distance; equal texts are settled without the quadratic part."""
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def edit_comparison(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """struct(distance, similarity), for callers that need both: one normalisation of
    each side and one distance."""

    def compare(a: Column, b: Column) -> Column:
        measured = F.struct(
            _distance(a, b).alias("distance"),
            F.greatest(F.length(a), F.length(b)).alias("longest"),
            ((a == "") | (b == "")).alias("one_empty"),
        )
        return let(measured, lambda m: F.struct(
            m["distance"].alias("distance"),
            F.when(m["distance"] == 0, 1.0)
            .when(m["one_empty"], 0.0)
            .otherwise(1.0 - m["distance"] / m["longest"])
            .alias("similarity"),
        ))

    return on_both(_or_empty(expected), _or_empty(predicted), normalize_for_distance, compare)


def levenshtein_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - distance / longer length, in [0, 1]."""
    return on_both(_c(a), _c(b), normalize_for_distance, _similarity)


def compare_levenshtein(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    return levenshtein_similarity(_or_empty(expected), _or_empty(predicted))


def token_set(value: ColumnOrName) -> Column:
    """Sorted distinct tokens; blanks and ``. - _ ' /`` separate them."""
    separators = ".-_'/" + WS_CHARS.replace(" ", "")
    spaced = F.translate(_lower_folded(_or_empty(value)), separators, " " * len(separators))
    return F.sort_array(F.array_distinct(F.array_remove(F.split(spaced, " "), "")))


def compare_token_set(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    return on_both(
        _c(expected), _c(predicted), token_set, lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    )


def normalize_person_name(value: ColumnOrName) -> Column:
    """Drop commas and the leading run of titles, collapse blanks; empty becomes null."""
    text = F.regexp_replace(F.replace(_c(value), F.lit(","), F.lit(" ")), rf"[{WS}]+", " ")
    return F.nullif(strip(F.regexp_replace(text, "(?i)" + PERSON_TITLE_PREFIX, "")), F.lit(""))


def field_label(name: ColumnOrName) -> Column:
    """``date_naissance`` to ``Date Naissance``."""
    return F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def truncate_preview(value: ColumnOrName, limit: int) -> Column:
    """Cut to ``limit`` characters and mark the cut with an ellipsis."""
    text = _c(value).cast("string")
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(
        text
    )


def to_ascii(value: ColumnOrName) -> Column:
    """ASCII rendering for header-safe values: decompose, drop the rest, trim."""
    source, target, longer = _ascii_table()

    def plain(text: Column) -> Column:
        simple = F.translate(text, source, target)
        return (
            F.when(~text.rlike(_NON_ASCII), text)
            .when(text.rlike(_char_class(longer, 0x40)), _expand(simple, longer))
            .otherwise(simple)
        )

    ascii_only = let(_c(value).cast("string"), plain)
    return strip(F.regexp_replace(ascii_only, _NON_ASCII, ""))


def sanitize_metadata_key(key: ColumnOrName) -> Column:
    """Header-safe key: lower case, blanks to ``-``, only ``a-z 0-9 . _ -``."""
    text = F.regexp_replace(F.lower(to_ascii(key)), r"\s+", "-")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9._\-]", ""), "-+", "-")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("meta"))


def sanitize_metadata_value(value: ColumnOrName) -> Column:
    """Header-safe value: ASCII, line breaks and runs of blanks become one space."""
    text = F.regexp_replace(to_ascii(value), r"[\r\n\t]+", " ")
    return F.regexp_replace(text, r"\s{2,}", " ")


def sanitize_metadata(metadata: ColumnOrName) -> Column:
    """Sanitised copy of a map<string,string>; null map gives an empty map.

    Keys that collapse to the same text keep the last value, so the entries are
    reduced before the map is built and no dedup setting of the session matters.
    """
    entries = F.transform(
        F.map_entries(_c(metadata)),
        lambda e: F.struct(
            sanitize_metadata_key(e["key"]).alias("key"),
            sanitize_metadata_value(e["value"]).alias("value"),
        ),
    )
    return F.coalesce(last_wins_map(entries), F.create_map().cast("map<string,string>"))


def last_wins_map(entries: Column) -> Column:
    """Array of (key, value) structs to a map where a repeated key keeps its last value.

    Entries are sorted by key and place, the last of each key stays, and the order of the
    places is restored.
    """
    placed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))

    def last_of_each(found: Column) -> Column:
        return F.filter(found, lambda e, i: ~F.get(found, i + 1)["key"].eqNullSafe(e["key"]))

    back = F.array_sort(F.transform(
        let(F.array_sort(placed), last_of_each),
        lambda e: F.struct(e["i"].alias("i"), e["key"].alias("key"), e["value"].alias("value")),
    ))
    return F.map_from_entries(F.transform(back, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))

"""Field comparison metrics as Column expressions, and their dispatch by name."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_METRIC, METRICS, SKIP_SCORE
from . import dates, numbers, text
from .binding import let, on_both
from .numbers import ColumnOrName, _c


def compare_equality(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """1.0 when equal; two missing values are equal."""
    return F.when(_c(expected).eqNullSafe(_c(predicted)), 1.0).otherwise(0.0)


def skip(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """Sentinel for fields that are not evaluated."""
    return F.lit(SKIP_SCORE)


def canonical_text(value: Column, dtype: T.DataType) -> Column:
    """Text that is equal for equal nested values, whatever the order of list items.

    Repeated list items count once, as in an order-free set comparison.
    """
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: canonical_text(x, dtype.elementType))
        out = F.concat(
            F.lit("["), F.array_join(F.sort_array(F.array_distinct(items)), ","), F.lit("]")
        )
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.concat(
                canonical_text(e["key"], dtype.keyType),
                F.lit(":"),
                canonical_text(e["value"], dtype.valueType),
            ),
        )
        out = F.concat(F.lit("{"), F.array_join(F.sort_array(pairs), ","), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        members = [
            F.concat(F.lit(json.dumps(f.name) + ":"), canonical_text(value[f.name], f.dataType))
            for f in sorted(dtype.fields, key=lambda f: f.name)
        ]
        out = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    else:
        out = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(out, F.lit("null"))


def compare_deep_typed(expected: Column, predicted: Column, dtype: T.DataType) -> Column:
    """Deep equality of two columns of one known nested type, list order ignored."""
    same = canonical_text(expected, dtype) == canonical_text(predicted, dtype)
    return F.when(same, 1.0).otherwise(0.0)


#: Levels of JSON text that ``compare_deep_json`` opens when it is not told how many there are.
JSON_LEVELS = 12


def json_brackets(text: ColumnOrName) -> Column:
    """The brackets of a JSON text; those inside strings do not count."""
    return F.regexp_replace(_c(text), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++|"', "")


def json_depth(text: ColumnOrName) -> Column:
    """How deep brackets nest in a JSON text; brackets inside strings do not count."""
    steps = F.split(json_brackets(text), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(at: Column, ch: Column) -> Column:
        now = at["now"] + F.when(ch.isin("[", "{"), 1).when(ch.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(steps, start, walk)["most"]


def _leaf(value: Column) -> Column:
    """A scalar as text; whole numbers and fractions stay apart, as they do in a deep comparison."""
    fraction = F.schema_of_variant(value).rlike("^(DECIMAL|DOUBLE$)")
    number = F.try_variant_get(value, "$", "double") + F.lit(0.0)
    return F.when(fraction, F.concat(F.lit("f"), number.cast("string"))).otherwise(F.to_json(value))


def _canonical(value: Column, levels: int) -> Column:
    """Digest of a VARIANT that is equal for equal values whatever the order of list items.

    A container's digest is made of the sorted digests of its members, so each level of the
    value is one level of this expression, and what a level hands up has a fixed size. The
    kind of container is its first member, so a value is opened once: what is neither a list
    nor a map has no members, thus no digest, and is a scalar.
    """
    if not levels:
        return F.to_json(value)

    def member(key: Column, of: Column) -> Column:
        return F.struct(key.alias("key"), of.alias("value"))

    def kind(bracket: str) -> Column:
        return F.array(member(F.lit(bracket), F.lit(None).cast("variant")))

    members = F.coalesce(
        F.concat(kind("["), F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: member(F.lit(""), x))),
        F.concat(kind("{"), F.transform(
            F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
            lambda e: member(F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit(":")), e["value"]),
        )),
    )
    digests = F.sort_array(F.array_distinct(
        F.transform(members, lambda m: F.concat(m["key"], F.coalesce(_canonical(m["value"], levels - 1), F.lit("null"))))
    ))
    return F.coalesce(F.concat(F.lit("#"), F.md5(F.array_join(digests, ",").cast("binary"))), _leaf(value))


def canonical_json(value: ColumnOrName, levels: int = JSON_LEVELS) -> Column:
    """Digest of a JSON text; a text that cannot be read, or repeats a key, stands for itself."""
    text = _c(value)
    return let(
        F.try_parse_json(text),
        lambda v: F.coalesce(
            F.when(v.isNotNull(), _canonical(v, levels)), F.concat(F.lit("text:"), text), F.lit("null")
        ),
    )


def compare_deep_json(expected: ColumnOrName, predicted: ColumnOrName, levels: int = JSON_LEVELS) -> Column:
    """Deep equality of two JSON texts, list order ignored; repeated list items count once.

    Equal texts are settled at once, only the others are opened, down to ``levels`` levels of
    nesting; what lies deeper is compared in its given order. ``deep_json_scores`` of the
    evaluation operators opens as many levels as the data has.
    """
    e, p = _c(expected), _c(predicted)
    return F.when(e.eqNullSafe(p), 1.0).when(
        on_both(e, p, lambda text: canonical_json(text, levels), lambda one, other: one == other), 1.0
    ).otherwise(0.0)


#: Longer texts have no pattern: theirs seldom recur, and finding one grows with the square of its scalars.
PATTERN_CHARS = 500
#: Stands between the two texts of a pattern; no JSON text holds this character.
PATTERN_BREAK = "\x02"

_CHAR = r'[^"\\\x00-\x1f]'
_COLON = r"[ \t\r\n]*+:"
_NUMBER = r"(?<![0-9.eE+-])-?[1-9][0-9]"
# what keeps its text: all but scalars, short scalars, keys, quotes that nothing closes, other numbers
_KEPT = "|".join([
    r'[^"0-9-]++', f'"{_CHAR}?"', r"[0-9](?![0-9])", f'"{_CHAR}*+"(?={_COLON})', f'"(?!{_CHAR}*+")',
    rf"{_NUMBER}*+(?=[0-9.eE+-]|{_COLON})", rf"{_NUMBER}{{18,}}+", rf"(?!{_NUMBER})[0-9-]",
])
_RENAMED = rf'\G((?:{_KEPT})*+)("{_CHAR}{{2,}}+"|-?[1-9][0-9]{{1,17}}+)'


def json_pattern(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """Two JSON texts, ``PATTERN_BREAK`` between them, with numbered names for their scalars.

    Equal scalars of the two get one name, others different ones, so all pairs of a pattern
    compare like the pattern itself. Numbers of 2 to 18 digits and strings of two characters or
    more are renamed to strings; one-character scalars, fractions and keys stay, as a text that
    cannot be read stays one. Null for equal texts, long ones, backslashes (an escape spells a
    character in another way) and what is neither a list nor a map.
    """
    e, p = _c(expected), _c(predicted)
    both = F.concat(e, F.lit(PATTERN_BREAK), p)
    fit = (e != p) & (F.length(e) <= PATTERN_CHARS) & (F.length(p) <= PATTERN_CHARS)
    for side in (e, p):
        fit = fit & (side.startswith("[") | side.startswith("{"))
        for sign in ("\\", "\x01", PATTERN_BREAK):
            fit = fit & ~side.contains(sign)
    renamed = let(
        F.split(F.regexp_replace(both, _RENAMED, "$1\x01$2\x01"), "\x01"),  # every second part is a scalar
        lambda parts: F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 0, part).otherwise(
            F.concat(F.lit('"n'), F.array_position(parts, part).cast("string"), F.lit('"')))), ""),
    )
    return F.when(fit, renamed)


SCORERS = {
    "equality": compare_equality,
    "levenshtein_distance": text.compare_levenshtein,
    # Label values are plain text, where deep equality is equality.
    "deep_equality": compare_equality,
    "string_date_equality": dates.compare_string_date,
    "compare_number": numbers.compare_number,
    "token_set_equality": text.compare_token_set,
    "skip": skip,
}


def score(
    metric: Column, expected: ColumnOrName, predicted: ColumnOrName, without: tuple[str, ...] = ()
) -> Column:
    """Score of one field under the metric named by a column; unknown names give null,
    as do those in ``without``, which a caller handles itself."""
    names: dict = {}
    for name, scorer in SCORERS.items():
        if name not in without:
            names.setdefault(scorer, []).append(name)
    chosen = None
    for scorer, called in names.items():
        hit = metric.isin(*called)
        value = scorer(expected, predicted)
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


def resolve_metrics(raw: ColumnOrName) -> Column:
    """Array of metric names to the valid ones in order; none left gives the default."""
    valid = F.filter(_c(raw), lambda m: m.isin(*METRICS))
    return F.when(F.coalesce(F.size(valid), F.lit(0)) > 0, valid).otherwise(
        F.array(F.lit(DEFAULT_METRIC))
    )


def resolve_metric_spec(spec: str | list[str] | None) -> list[str]:
    """Driver-side twin for declarations: a name, a list of names or nothing."""
    names = [spec] if isinstance(spec, str) else list(spec or [])
    return [n for n in names if n in METRICS] or [DEFAULT_METRIC]

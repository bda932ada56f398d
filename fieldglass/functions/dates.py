"""Dates written in several styles: normalisation, comparison, clamped parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAD_DATE_MESSAGE, WS_CHARS
from .binding import let, on_both
from .numbers import ColumnOrName, _c

_DAY = r"(?:0?[1-9]|[12]\d|3[01]| [1-9])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_YEAR = r"(?!0000)\d{4}"


def strip(value: ColumnOrName) -> Column:
    """Remove leading and trailing white space, Unicode blanks included."""
    return F.btrim(_c(value).cast("string"), F.lit(WS_CHARS))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, null when there is no such day.

    Checked by arithmetic: a parser would report each wrong day by an exception,
    which is far slower than the date it protects.
    """
    first = F.when(year.between(1, 9999) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when(
        (day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.make_date(year, month, day)
    )


def normalize_string_date(value: ColumnOrName) -> Column:
    """Text to date, or null.

    Day-first and year-first spellings with one repeated separator exclude each
    other; only eight bare digits are ambiguous and there day-first is tried first.
    """

    def from_parts(parts: Column) -> Column:
        year_first = F.length(parts[0]) == 4
        year = F.when(year_first, parts[0]).otherwise(parts[2]).cast("int")
        day = F.when(year_first, parts[2]).otherwise(parts[0]).cast("int")
        return calendar_date(year, parts[1].cast("int"), day)

    def digits(s: Column, start: int, length: int) -> Column:
        return F.substring(s, start, length).cast("int")

    def read(s: Column) -> Column:
        separated = s.rlike(
            rf"^(?:{_DAY}([/.\-]){_MONTH}\1{_YEAR}|{_YEAR}([/.\-]){_MONTH}\2{_DAY})$"
        )
        parts = F.split(F.translate(s, "-. ", "//"), "/")
        return F.when(separated, let(parts, from_parts)).when(
            s.rlike(r"^\d{8}$"),
            F.coalesce(
                calendar_date(digits(s, 5, 4), digits(s, 3, 2), digits(s, 1, 2)),
                calendar_date(digits(s, 1, 4), digits(s, 5, 2), digits(s, 7, 2)),
            ),
        )

    return let(strip(value), read)


def compare_string_date(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """1.0 when both sides are dates and equal; a missing date never matches."""
    return on_both(
        _c(expected), _c(predicted), normalize_string_date,
        lambda a, b: F.when(a == b, 1.0).otherwise(0.0),
    )


def parse_flexible_date(value: ColumnOrName) -> Column:
    """struct(value date, clamped boolean, error string).

    A day past the end of its month is moved back to the last day. Null, blank and
    the words null/none give no date and no error; anything else unreadable gives an
    error text.
    """
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    dmy = r"^(\d{1,2})([/.\-])(\d{1,2})\2(\d{4})$"

    def parts(s: Column) -> Column:
        def part(iso_group: int, day_first_group: int) -> Column:
            picked = F.when(s.rlike(ymd), F.regexp_extract(s, ymd, iso_group)).otherwise(
                F.regexp_extract(s, dmy, day_first_group)
            )
            return picked.try_cast("int")

        return F.struct(
            s.alias("s"), part(1, 4).alias("y"), part(2, 3).alias("m"), part(3, 1).alias("d")
        )

    def month_start(p: Column) -> Column:
        usable = p["y"].between(1, 9999) & p["m"].between(1, 12) & (p["d"] >= 1)
        first = F.make_date(p["y"], p["m"], F.lit(1))
        return F.struct(p["s"].alias("s"), p["d"].alias("d"), F.when(usable, first).alias("first"))

    def clamp(p: Column) -> Column:
        last_day = F.dayofmonth(F.last_day(p["first"]))
        date = F.date_add(p["first"], F.least(p["d"], last_day) - 1)
        absent = p["s"].isNull() | F.lower(p["s"]).isin("null", "none", "")
        return F.struct(
            date.alias("value"),
            F.coalesce(p["d"] > last_day, F.lit(False)).alias("clamped"),
            F.when(~absent & p["first"].isNull(), F.concat(F.lit(BAD_DATE_MESSAGE), p["s"]))
            .alias("error"),
        )

    return let(let(let(strip(value), parts), month_start), clamp)


def elapsed_ms(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole milliseconds from start to end."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return (micros / 1000).cast("long")

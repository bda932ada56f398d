"""Messy numbers: normalisation and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_number(value: ColumnOrName) -> Column:
    """Text to double, or null.

    The comma becomes a dot and everything but digits, dot and minus is dropped.
    What is left has no exponent letter, so a second dot or minus can never be a
    valid double and ``try_cast`` alone rejects it.
    """
    text = F.translate(_c(value).cast("string"), ", ", ".")
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def compare_number(expected: ColumnOrName, predicted: ColumnOrName) -> Column:
    """1.0 when the numbers agree; two missing numbers agree."""
    return F.when(
        normalize_number(expected).eqNullSafe(normalize_number(predicted)), 1.0
    ).otherwise(0.0)


def clean_float_label(value: ColumnOrName) -> Column:
    """Strict variant for decoded labels: only blanks go, anything else must parse."""
    return F.translate(_c(value).cast("string"), ", ", ".").try_cast("double")

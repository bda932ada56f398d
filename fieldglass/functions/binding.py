"""Naming an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Substituting an expression into several places multiplies both its cost and the
    size of the plan; a lambda variable over a one-element array does not.
    """
    return F.transform(F.array(value), body)[0]


def on_both(
    first: Column, second: Column, each: Callable[[Column], Column],
    body: Callable[[Column, Column], Column],
) -> Column:
    """``body(each(first), each(second))`` with ``each`` in the plan only once."""
    return let(F.transform(F.array(first, second), each), lambda pair: body(pair[0], pair[1]))

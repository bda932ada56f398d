"""Column helpers shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these (fixed value).
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words of a whole text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

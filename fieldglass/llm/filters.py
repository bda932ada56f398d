"""Filters of fixed size that say which rows may have a partner, so that the others need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter; its size never changes.
FILTER_BITS = 1 << 26
SLOT = "__slot"


def bitmap_of(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of hashed ids, put together by Spark; FILTER_BITS / 8 bytes at most."""
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    rows = ids.select(F.floor(slot / 64).cast("int").alias("w"), (slot % 64).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")
    ).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return words


def slot_of(column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))


def hit(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots // 64] >> (slots % 64)) & 1 == 1


def _choosing(bitmap, wanted: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(SLOT)
            rows = hit(bitmap.value, batch.column(at).to_numpy()) == wanted
            yield batch.filter(pa.array(rows))

    return run


def join_some(docs: DataFrame, ids: DataFrame, key: str, join: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows joined, rows that surely have no partner) of ``docs`` against a table of bigint ``key``.

    Only rows whose id may be among ``ids`` enter ``join``; the rest is never shuffled. Rows
    that the filter lets through by chance meet the join like any other.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, key))
    slotted = docs.withColumn(SLOT, slot_of(key))
    schema = slotted.schema
    some = slotted.mapInArrow(_choosing(bitmap, True), schema).drop(SLOT)
    rest = slotted.mapInArrow(_choosing(bitmap, False), schema).drop(SLOT)
    return join(some), rest


def shielded(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns of the given names set aside, and what brings them back."""
    away = {c: f"__own_{c}" for c in docs.columns if c in names}
    columns = docs.columns
    return docs.withColumnsRenamed(away), lambda df: df.select(*[F.col(away.get(c, c)).alias(c) for c in columns])

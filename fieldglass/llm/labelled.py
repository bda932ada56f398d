"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept_table
from .native import crc_of_id

#: Rows of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 12_000
PLACES = 1 << 40


def held_out(doc_id, parts: int = 3, which: int = 1):
    return F.pmod(crc_of_id(doc_id), F.lit(parts)) == which


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of a sample of labelled rows that are not held out, kept in a table.

    Of each class the ``per_class`` rows of smallest hash are taken, so the sample is fixed
    and bounded; the counts of all rows by class come with it. Rows without an id or label
    do not count, and an id labelled twice has its larger label.
    """
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))

    def chosen(y: int) -> DataFrame:
        # the hash leaves a tenth more than wanted, so that few rows are ordered
        share = min(1.0, 1.1 * per_class / max(1, counts.get(y, 0)))
        few = rows.filter((F.col("y") == y) & (place < int(share * PLACES)))
        return few.orderBy(place, "id").limit(per_class)

    # two times per_class rows of an id and a label: small enough to send everywhere
    sample = F.broadcast(chosen(0).unionByName(chosen(1)))
    joined = docs.join(sample, docs["doc_id"] == sample["id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    return kept_table(joined, "training"), counts

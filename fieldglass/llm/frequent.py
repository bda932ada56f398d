"""The most frequent keys of a table of counts, found without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows of the largest counts, ``limit`` at most.

    A histogram over steps of about one percent gives the step from which on no more than
    ``limit`` rows are left; rows of one step stay or go together. Counts are at least 1.
    """
    step = F.floor(F.log2(column) * 64)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect()
    least, total = None, 0
    for row in steps:
        total += row["n"]
        if total > limit:
            break
        least = row["step"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)

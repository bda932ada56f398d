"""Run a stream over what is there now and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_dir


def run_available(
    stream: DataFrame,
    path: str | None = None,
    mode: str = "append",
    each: Callable[[DataFrame, int], None] | None = None,
    checkpoint: str | None = None,
    partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> StreamingQuery:
    """Process everything available, to parquet at ``path`` or to ``each(batch, id)``.

    ``partitions`` is the number of state partitions of a new query. It is fixed for
    the life of a checkpoint, so it is given here and not left to a session default.
    A query keeps the ``settings`` it was started with; the session gets its own back.
    """
    spark = stream.sparkSession
    chosen = dict(settings or {})
    if partitions:
        chosen["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in chosen}
    for name, value in chosen.items():
        spark.conf.set(name, value)
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "offsets"))
        .trigger(availableNow=True)
    )
    try:
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that overwrites its own batch folder, so a repeated batch
    after a failure leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write

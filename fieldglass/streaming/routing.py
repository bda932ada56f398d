"""Retry, dead-letter and notification routing of a message stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import messages as M
from ..operators.tenancy import finished_to_notify, webhook_fanout


def route_batch(path: str, consumer: str, keys: tuple[str, ...], exact: bool = True,
                max_deliveries: int = K.MAX_DELIVERIES) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: decode, route, write one folder per route and batch.

    The routed batch is written once, foldered by route, and each consumer reads its
    own folder: requeue feeds the retry topic, dlq the dead letters. Committing the
    micro-batch is the acknowledgement; a repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = M.route_outcomes(M.decoded(batch, keys, exact), max_deliveries)
        (
            routed.drop("message").withColumn("consumer", F.lit(consumer))
            .write.mode("overwrite").partitionBy("route")
            .parquet(f"{path}/batch_id={batch_id}")
        )

    return write


def decode_stream(messages: DataFrame, keys: tuple[str, ...], exact: bool = True,
                  ) -> tuple[DataFrame, DataFrame]:
    """(messages that decode, messages for the dead-letter sink)."""
    seen = M.decoded(messages, keys, exact)
    bad = seen.filter(F.col("message").isNull()).withColumn("reason", F.lit("decode_error"))
    return seen.filter(F.col("message").isNotNull()), bad.drop("message")


def notify_finished(results: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Stream of results joined with the webhook table: one message per webhook."""
    return webhook_fanout(finished_to_notify(results), webhooks)


def trim_batch(path: str, maxlen: int = K.STREAM_MAXLEN,
               keys: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` compaction: keep the newest ``maxlen`` of old and new messages.

    Version n is built from version n-1 and the batch, so a repeated batch gives the
    same version. Only the versions in use need to be kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch
        if batch_id > 0:
            kept = batch.sparkSession.read.parquet(f"{path}/version={batch_id - 1}").unionByName(batch)
        M.trim_stream(kept, maxlen, keys).write.mode("overwrite").parquet(
            f"{path}/version={batch_id}"
        )

    return write

"""Quotas on a request stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.quota import request_ordinals, verdict
from ..operators.slices import AT, attach_summary, place
from ..session import drop_folder


def quota_windows(requests: DataFrame, size: str, key: str = "api_key",
                  late: str = "1 hour") -> DataFrame:
    """Requests per key and tumbling window of ``size`` ('1 minute', '1 day').

    Partial counts are made before the shuffle. Rows later than ``late`` behind the
    watermark are dropped, which is what bounds the state.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", size), key)
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(key, F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "requests")
    )


def verdict_batch(path: str, per_minute: int = K.LIMIT_PER_MINUTE, per_day: int = K.LIMIT_PER_DAY,
                  key: str = "api_key", late_s: int = K.QUOTA_LATE_SECONDS,
                  quorum: int = K.QUOTA_QUORUM) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a decision for every request of the stream.

    The batch is numbered like the batch operator does it and continues from counters
    carried per (key, minute) and (key, day), so requests are counted in order of arrival:
    file by file, by time and id inside one. A busy key is spread over its seconds instead of
    being one piece of streaming state.

    Counters expire by a watermark that is carried with them: ``late_s`` seconds behind the
    minute that ``quorum`` requests have reached or passed. A few requests with a time far
    ahead therefore move nothing; they are counted in their own windows. A request whose day
    has expired finds no counter any more and goes to the rejected table, never to a new count.

    Folders: ``verdicts``, ``rejected``, ``counters`` and ``progress``, one ``batch_id=n``
    each. All of batch n is built from batch n-1 and the batch, so a repeated batch writes
    the same again; older counters are removed.
    """

    def counters(decided: DataFrame) -> DataFrame:
        minutes = decided.groupBy(key, F.date_trunc("minute", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
        days = minutes.groupBy(key, F.date_trunc("day", "start").alias("start")).agg(F.sum("n").alias("n"))
        return minutes.withColumn("size", F.lit("minute")).unionByName(days.withColumn("size", F.lit("day")))

    def expired(start: str, passed) -> Column:
        """Whether the day of a time ended before the watermark."""
        return F.date_trunc("day", start) + F.expr("INTERVAL 1 DAY") <= F.lit(passed)

    def reached(now: DataFrame):
        """The latest minute that ``quorum`` requests have reached; no more than as many rows come here."""
        ahead = now.filter(F.col("size") == "minute").groupBy("start").agg(F.sum("n").alias("n"))
        total = 0
        for row in ahead.orderBy(F.col("start").desc()).limit(quorum).collect():
            total += row["n"]
            if total >= quorum:
                return row["start"] - dt.timedelta(seconds=late_s)
        return None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        carried, passed = None, None
        if batch_id > 0:
            carried = spark.read.parquet(f"{path}/counters/batch_id={batch_id - 1}")
            passed = spark.read.parquet(f"{path}/progress/batch_id={batch_id - 1}").first()["watermark"]
        late = F.lit(False) if passed is None else expired("ts", passed)
        timed.filter(late).withColumn("reason", F.lit("day_expired")).write.mode("overwrite").parquet(
            f"{path}/rejected/batch_id={batch_id}")
        numbered = request_ordinals(timed.filter(~late), key)
        if carried is not None:
            for size in ("minute", "day"):
                before = place(carried.filter(F.col("size") == size), [key], F.col("start"))
                numbered = (
                    attach_summary(
                        place(numbered, [key], F.col(f"{size}_start")),
                        before.withColumnRenamed("n", "carry"), ["carry"],
                    )
                    .withColumn(f"{size}_count", F.col(f"{size}_count") + F.coalesce("carry", F.lit(0)))
                    .drop("carry", AT)
                )
        decided_at = f"{path}/verdicts/batch_id={batch_id}"
        verdict(numbered, per_minute, per_day).write.mode("overwrite").parquet(decided_at)
        # counters come from what was written, so the batch is numbered once
        now = counters(spark.read.parquet(decided_at).select(key, "ts"))
        if carried is not None:
            now = carried.unionByName(now).groupBy(key, "size", "start").agg(F.sum("n").alias("n"))
        all_at = f"{path}/counted/batch_id={batch_id}"
        now.write.mode("overwrite").parquet(all_at)
        now = spark.read.parquet(all_at)
        moved = reached(now)
        passed = max((t for t in (passed, moved) if t is not None), default=None)
        kept = now if passed is None else now.filter(~expired("start", passed))
        kept.write.mode("overwrite").parquet(f"{path}/counters/batch_id={batch_id}")
        spark.createDataFrame([(passed,)], "watermark timestamp").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/progress/batch_id={batch_id}")
        drop_folder(spark, all_at)
        for folder in ("counters", "progress"):
            drop_folder(spark, f"{path}/{folder}/batch_id={batch_id - 2}")

    return write

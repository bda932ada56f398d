"""Stateful streams: current status, waiting with a deadline, reclaiming idle messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators.events import status_of
from ..session import drop_folder

# Start the two timer-driven streams with this setting: state in RocksDB spills to
# disk and is what timers need.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _timed(events: DataFrame, late_s: int, *columns: str) -> DataFrame:
    """The given columns and ``us``, the event time in microseconds, behind a watermark.

    The time column itself is left out, so the stateful operator after it meets late rows
    too and can say what becomes of them, instead of losing them.
    """
    stamped = events.withColumn("at", F.col("created_at").cast("timestamp")).withColumn("us", F.unix_micros("at"))
    return stamped.withWatermark("at", f"{late_s} seconds").select("us", *columns)


def execution_state(events: DataFrame, band_s: int = K.STATUS_BAND_SECONDS, *, late_s: int) -> DataFrame:
    """Newest event and number of events per execution and band of event time.

    An aggregation with partial results map-side, to be run in update mode. A band leaves the
    state when the watermark has passed its end, so the state holds what happened in the last
    ``band_s`` + ``late_s`` seconds, not every execution there ever was, and a long execution
    is as many pieces as it has bands. ``status_batch`` keeps the rows as a table,
    ``status_table`` puts the bands together. Rows later than ``late_s`` seconds are dropped
    when their band has ended.
    """
    at = F.col("created_at").cast("timestamp")
    timed = events.withColumn("at", at).withWatermark("at", f"{late_s} seconds")
    newest = F.max(F.struct(
        F.unix_micros("at").alias("us"), F.col("id").cast("bigint").alias("id"), "event_type", "workflow_id",
        F.col("organization_id").cast("bigint").alias("organization_id"),
    ))
    per = timed.groupBy(F.window("at", f"{band_s} seconds").alias("w"), "execution_id").agg(
        newest.alias("e"), F.count(F.lit(1)).alias("events")
    )
    return per.select("execution_id", F.unix_micros("w.end").alias("band_end"), "e.*", "events")


_BANDS = ("execution_id string, band_end bigint, us bigint, id bigint, event_type string, workflow_id string,"
          " organization_id bigint, events bigint, batch_id int, ended boolean")


def _bands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BANDS).parquet(f"{path}/bands")


def status_batch(path: str, late_s: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of ``execution_state``: a status table in versions.

    Version n holds the bands of the batch and those that were open in version n-1. Bands that
    ended before the watermark, as far as version n-1 tells it, are put apart in it and never
    touched again, so what is carried on is no larger than the state. A repeated batch writes
    the same version again; open parts that no repeat needs are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, passed = batch, None
        if batch_id > 0:
            before = _bands(spark, path).filter((F.col("batch_id") == batch_id - 1) & ~F.col("ended"))
            newest = before.agg(F.max("us").alias("us")).first()["us"]
            passed = None if newest is None else newest - late_s * 1_000_000
            rows = batch.unionByName(before.drop("batch_id", "ended"))
        # a band comes out whole each time it grows, so its longest count is its state
        members = F.struct("events", "us", "id", "event_type", "workflow_id", "organization_id")
        latest = rows.groupBy("execution_id", "band_end").agg(F.max(members).alias("e")).select("execution_id", "band_end", "e.*")
        ended = F.lit(False) if passed is None else F.col("band_end") <= passed
        latest.withColumn("ended", ended).write.mode("overwrite").partitionBy("ended").parquet(f"{path}/bands/batch_id={batch_id}")
        drop_folder(spark, f"{path}/bands/batch_id={batch_id - 2}/ended=false")

    return write


def status_table(spark: SparkSession, path: str) -> DataFrame:
    """Current status of every execution that ``status_batch`` has seen."""
    rows = _bands(spark, path)
    version = rows.agg(F.max("batch_id").alias("n")).first()["n"]
    rows = rows.filter(F.col("ended") | (F.col("batch_id") == F.lit(version)))
    newest = F.max(F.struct("us", "id", "event_type", "workflow_id", "organization_id"))
    return rows.groupBy("execution_id").agg(newest.alias("e"), F.sum("events").alias("events")).select(
        "execution_id", F.timestamp_micros("e.us").alias("updated_at"), F.col("e.id").alias("event_id"), "e.workflow_id",
        "e.organization_id", status_of(F.col("e.event_type")).alias("status"), "events",
    )


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    """Rows as one state value: an Arrow stream."""
    table = pa.Table.from_pandas(frame, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(state: ListState) -> pd.DataFrame | None:
    """The rows that ``_packed`` put into a list state, or None."""
    if not state.exists():
        return None
    tables = [pa.ipc.open_stream(value[0]).read_all() for value in state.get()]
    return pa.concat_tables(tables, promote_options="permissive").to_pandas()


_PACKED = T.StructType([T.StructField("rows", T.BinaryType())])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def await_with_timeout(events: DataFrame, timeout_s: int = K.WAIT_DEFAULT_SECONDS,
                       cap_s: int = K.WAIT_CAP_SECONDS, *, late_s: int, buckets: int = K.AWAIT_BUCKETS) -> DataFrame:
    """For each start event its first result within the wait, or TIMEOUT; and what came too late.

    State is kept per bucket of executions and band of time as long as the wait, so an execution
    is as many pieces as it lasts waits, not one. A start belongs to its band, a result to its
    band and the one before, which are all the bands whose starts it can answer. A start is
    answered when the watermark has passed its deadline, whatever the order of arrival; the
    last timer of a band clears it. Rows behind the watermark still answer starts that are
    open, but may have come after the answer of others: such a row comes out once more with
    the status LATE, for the table that ``split_late`` gives. ``late_s`` is the allowed
    lateness in seconds and should cover the real delays. ``buckets`` is fixed for the life of
    a checkpoint; a bucket's rows of one band meet as Arrow tables, not one call per execution.
    """
    wait_us = min(timeout_s or K.WAIT_DEFAULT_SECONDS, cap_s) * 1_000_000
    started = K.STARTED
    names = {K.FAILED: "FAILED", K.COMPLETED: "SUCCESS"}
    columns = ["execution_id", "start_id", "status", "result_id"]

    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getListState("open", _PACKED)
            self.results = handle.getListState("results", _PACKED)
            self.due = handle.getValueState("due", T.StructType([T.StructField("us", T.LongType())]))
            self.handle = handle

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            band, passed = key[1], timerValues.getCurrentWatermarkInMs() * 1000
            end = (band + 2) * wait_us
            due = before = self.due.get()[0] if self.due.exists() else None
            for batch in rows:
                is_start = batch["event_type"] == started
                # a start whose deadline has passed, or a result that others may have waited for
                refused = is_start & (batch["us"] + wait_us < passed)
                own = ~is_start & (batch["us"] // wait_us == band) & (batch["us"] < passed)
                starts = batch.loc[is_start & ~refused, ["execution_id", "us", "id"]]
                results = batch.loc[~is_start & (end >= passed), ["execution_id", "us", "id", "event_type"]]
                if due is None and (len(starts) or len(results)):
                    due = end
                    self.handle.registerTimer(end // 1000 + 1)
                if len(starts):
                    due = min(due, int(starts["us"].min()) + wait_us)
                    self.open.appendValue(_packed(starts))
                if len(results):
                    self.results.appendValue(_packed(results))
                late = batch.loc[refused | own]
                if len(late):
                    yield self.frame(late["execution_id"], None, "LATE", late["id"])
            if due != before:
                self.due.update((due,))
                if due < end:
                    self.handle.registerTimer(due // 1000 + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # every deadline that has passed is answered at once; earlier timers find nothing due
            now_us = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
            if not self.due.exists() or self.due.get()[0] >= now_us:
                return
            end = (key[1] + 2) * wait_us
            waiting, results, still = _unpacked(self.open), _unpacked(self.results), None
            if waiting is not None:
                passed = waiting["us"] + wait_us < now_us
                waiting, still = waiting[passed], waiting[~passed]
            if now_us > end:
                for state in (self.open, self.results, self.due):
                    state.clear()
            else:
                due = end
                if still is not None and len(still):
                    due = int(still["us"].min()) + wait_us
                    self.open.put([_packed(still)])
                    self.handle.registerTimer(due // 1000 + 1)
                else:
                    self.open.clear()
                self.due.update((due,))
            if waiting is not None and len(waiting):
                yield self.answers(waiting, results)

        def answers(self, waiting: pd.DataFrame, results: pd.DataFrame | None) -> pd.DataFrame:
            """The first result of each start's execution, by time and id, from the start to its deadline."""
            if results is None:
                return self.frame(waiting["execution_id"], waiting["id"], "TIMEOUT", None)
            first = results.sort_values(["us", "id"]).drop_duplicates(["execution_id", "us"])
            # the ids go into the join as nullable numbers, which hold every bigint
            first = first.rename(columns={"id": "result_id"}).astype({"result_id": "Int64"})
            found = pd.merge_asof(waiting.sort_values("us"), first, on="us", by="execution_id", direction="forward", tolerance=wait_us)
            status = found["event_type"].map(names).fillna("UNSUPPORTED").mask(found["result_id"].isna(), "TIMEOUT")
            return self.frame(found["execution_id"], found["id"], status, found["result_id"])

        def frame(self, *values) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(columns, values))).astype({"start_id": "Int64", "result_id": "Int64"})

        def close(self) -> None:
            pass

    band = F.floor(F.col("us") / wait_us)
    bands = F.when(F.col("event_type") == started, F.array(band)).otherwise(F.array(band - 1, band))
    # other events answer a wait as unsupported, null ones too
    rows = _timed(events, late_s, "execution_id", F.col("id").cast("bigint").alias("id"), "event_type", _bucket("execution_id", buckets))
    return rows.withColumn("band", F.explode(bands)).groupBy("bucket", "band").transformWithStateInPandas(
        statefulProcessor=Waiting(),
        outputStructType="execution_id string, start_id bigint, status string, result_id bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def split_late(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered starts, rows that came behind the watermark) of ``await_with_timeout``."""
    late = F.col("status") == "LATE"
    return answers.filter(~late), answers.filter(late).select("execution_id", F.col("result_id").alias("event_id"))


def reclaim_stream(deliveries: DataFrame, idle_ms: int = K.IDLE_MS, max_deliveries: int = K.MAX_DELIVERIES,
                   *, late_s: int, buckets: int = K.RECLAIM_BUCKETS) -> DataFrame:
    """Messages delivered but not acknowledged for ``idle_ms``: requeue or dead letter.

    Input rows are (msg_id, at, kind, retries, data) with kind ``delivered`` or
    ``acked``. An acknowledgement leaves only a mark, so that a delivery that arrives
    after it is not reclaimed, and the mark is cleared once no row of the message can
    come any more. The newest delivery gives retries and data. ``late_s`` is the allowed
    lateness in seconds. State is kept per bucket of messages and put together as Arrow
    tables, not one call per message; ``buckets`` is fixed for the life of a checkpoint.
    """

    late_ms = late_s * 1000
    columns = ["msg_id", "data", "route", "reason", "next_retries"]

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per message: its newest delivery, its newest time, whether it is acknowledged."""
        # deliveries after acknowledgements, so that the last row of a message is a delivery where it has one
        ordered = rows.sort_values(["sent", "retries"], na_position="first")
        per = rows.groupby("msg_id", sort=False).agg(ms=("ms", "max"), acked=("acked", "any"))
        newest = ordered.drop_duplicates("msg_id", keep="last").set_index("msg_id")[["sent", "retries", "data"]]
        out = per.join(newest).reset_index()
        out["data"] = out["data"].astype("object").mask(out["acked"], None)
        return out

    def due_of(rows: pd.DataFrame) -> pd.Series:
        return rows["ms"] + (idle_ms + 1) + rows["acked"] * late_ms

    class Pending(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.pending = handle.getListState("pending", _PACKED)
            self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))
            self.handle = handle

        def expect(self, due: int) -> None:
            self.due.update((due,))
            self.handle.registerTimer(due)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.due.get()[0] if self.due.exists() else None
            due = before
            for batch in rows:
                some = batch[["msg_id", "ms", "retries", "data"]].assign(acked=batch["kind"] == "acked")
                some["sent"] = some["ms"].astype("Int64").mask(some["acked"])
                # other rows of a message can only put its time off
                first = int(due_of(some).min())
                due = first if due is None else min(due, first)
                self.pending.appendValue(_packed(some))
            if due != before:
                self.expect(due)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, expiry = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
            found = _unpacked(self.pending)
            if found is None or self.due.get()[0] > max(now - 1, expiry):
                return
            found = merged(found)
            due = due_of(found)
            over = (due < now) | (due <= expiry)
            still = found[~over]
            if len(still):
                self.pending.put([_packed(still)])
                self.expect(int(due[~over].min()))
            else:
                self.pending.clear()
                self.due.clear()
            idle = found[over & ~found["acked"]]
            if len(idle):
                retry = idle["retries"].astype("Int64") + 1
                dead = retry > max_deliveries
                yield pd.DataFrame({
                    "msg_id": idle["msg_id"], "data": idle["data"], "route": dead.map({True: "dlq", False: "requeue"}),
                    "reason": dead.map({True: "max_retries_exceeded", False: None}), "next_retries": retry.mask(dead),
                }, columns=columns)

        def close(self) -> None:
            pass

    stamped = (
        deliveries.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", f"{late_s} seconds")
        .select(F.col("msg_id").cast("string").alias("msg_id"), "at", F.unix_millis("at").alias("ms"), "kind",
                F.coalesce(F.col("retries"), F.lit(0)).cast("int").alias("retries"), "data")
        .withColumn("bucket", _bucket("msg_id", buckets))
    )
    return stamped.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Pending(),
        outputStructType="msg_id string, data string, route string, reason string, next_retries int",
        outputMode="Append",
        timeMode="EventTime",
    )

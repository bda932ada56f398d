"""Questions over the append-only execution event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import ColumnOrName, _c
from ..functions.protect import redact_payload, redaction_by_column
from ..schemas import EVENT_PAYLOAD
from .slices import ordinal_in_group

EVENT_ORDER = ("created_at", "id")


def events_of(events: DataFrame, execution_id, workflow_id=None) -> DataFrame:
    found = events.filter(F.col("execution_id") == execution_id)
    return found.filter(F.col("workflow_id") == workflow_id) if workflow_id else found


def pending_before(events: DataFrame, cutoff: ColumnOrName | object) -> DataFrame:
    """Events up to the cutoff that still wait for redaction."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return events.filter((F.col("created_at") <= limit) & (F.col("anonymization_status") == "PENDING"))


def owned_by(rows: DataFrame, organization: ColumnOrName, negate: bool = False) -> DataFrame:
    """Rows of one organization, or with ``negate`` the violations."""
    org = organization if isinstance(organization, Column) else F.lit(organization)
    same = F.coalesce(F.col("organization_id") == org, F.lit(False))
    return rows.filter(~same if negate else same)


def valid_enum(df: DataFrame, column: str, allowed: tuple[str, ...],
               lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into rows with an allowed value and rejected rows (nulls included)."""
    value = F.lower(F.col(column)) if lower else F.col(column)
    ok = F.coalesce(value.isin(*allowed), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def event_records(events: DataFrame) -> DataFrame:
    """Typed projection of stored events."""
    return events.select(
        "id", "workflow_id", "execution_id", "organization_id", "created_at", "event_type", "event"
    )


def parse_event_payload(events: DataFrame, column: str = "event", into: str = "payload") -> DataFrame:
    """Parse the JSON payload; ``payload_error`` is set for unknown types and bad JSON."""
    parsed = F.from_json(column, EVENT_PAYLOAD, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json(column).isNotNull()
    known = F.col("event_type").isin(*K.EVENT_TYPES)
    return events.withColumns(
        {
            into: F.when(known & readable, parsed),
            "payload_error": F.when(
                ~F.coalesce(known, F.lit(False)),
                F.concat(F.lit("Unsupported event type: "),
                         F.coalesce(F.col("event_type"), F.lit("null"))),
            ).when(~readable, "unreadable payload"),
        }
    )


def valid_ranges(df: DataFrame, rules: dict[str, tuple[float | None, float | None]],
                 ) -> tuple[DataFrame, DataFrame]:
    """Split by numeric ranges (low, high), open ends as None; nulls pass."""
    ok = F.lit(True)
    for name, (low, high) in rules.items():
        value = F.col(name)
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        ok = ok & (value.isNull() | inside)
    return df.filter(ok), df.filter(~ok)


def _near_bounds(events: DataFrame, key: str, bounds: dict[str, Column], near: Callable[[Callable], Column]) -> DataFrame:
    """The events of each group that ``near`` accepts, given the group's bounds by name.

    The bounds are fixed-width values of the key and a few columns, found by hashing; whole
    rows are read again only for what they select, where Spark's runtime filter applies.
    """
    found = events.groupBy(F.col(key).alias("__key")).agg(*[b.alias(f"__{n}") for n, b in bounds.items()])
    same = events[key].eqNullSafe(found["__key"]) & near(lambda name: found[f"__{name}"])
    return events.join(found, same).drop("__key", *[f"__{n}" for n in bounds])


def last_event(events: DataFrame, key: str = "execution_id") -> DataFrame:
    """Newest event per execution, ties broken by id: the newest time of each execution first,
    then the rows of that time."""
    newest = _near_bounds(
        events, key, {"newest": F.max("created_at")}, lambda b: events["created_at"].eqNullSafe(b("newest"))
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("id").desc()))
    return newest.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def resumable_executions(events: DataFrame, mode: str = "latest") -> DataFrame:
    """Start event of every execution that should run (again).

    The deciding event is the newest one (``mode="latest"``) or, as the original
    lookup did by accident, the oldest (``mode="reference"``). Started: that event.
    Failed with a retryable error: the earliest start. Anything else: no row.

    Only the events at the deciding time and at the first start's time are looked at whole.
    """
    latest = mode == "latest"
    started = F.col("event_type") == K.STARTED
    bounds = {"edge": (F.max if latest else F.min)("created_at"), "start": F.min(F.when(started, F.col("created_at")))}
    few = _near_bounds(
        events, "execution_id", bounds,
        lambda b: events["created_at"].eqNullSafe(b("edge"))
        | ((events["event_type"] == K.STARTED) & (events["created_at"] == b("start"))),
    )
    order = [F.col(c).desc() if latest else F.col(c).asc() for c in EVENT_ORDER]
    first = Window.partitionBy("execution_id").orderBy(*order)
    starts = Window.partitionBy("execution_id", "__started").orderBy(*EVENT_ORDER)
    retry = (F.col("event_type") == K.FAILED) & (F.col("error_type") == K.RETRYABLE_ERROR)
    placed = few.withColumns({
        "__decides": F.row_number().over(first) == 1, "__started": F.coalesce(started, F.lit(False)),
    }).withColumns({
        "__first_start": F.col("__started") & (F.row_number().over(starts) == 1),
        "__retry": F.bool_or(F.col("__decides") & F.coalesce(retry, F.lit(False))).over(Window.partitionBy("execution_id")),
    })
    chosen = (F.col("__decides") & F.col("__started")) | (F.col("__retry") & F.col("__first_start"))
    return placed.filter(chosen).select(*events.columns)


def event_stream_summary(events: DataFrame) -> DataFrame:
    """Per execution: event count, first and last time, workflow of the first event."""
    return events.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.min("created_at").alias("first_event_at"),
        F.max("created_at").alias("last_event_at"),
        F.min_by("workflow_id", F.struct(*EVENT_ORDER)).alias("workflow_id"),
    )


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0,
         slice_by: Column | None = None) -> DataFrame:
    """Ordered page; no limit (or 0) means the rest of the table.

    The rest behind an offset is found by ordinals counted slice by slice, when a
    ``slice_by`` that does not decrease along the order is given; without one it passes
    through one task.
    """
    if offset > 0 and not limit and slice_by is not None:
        numbered = ordinal_in_group(df, [], order, slice_by, "__ordinal")
        return numbered.filter(F.col("__ordinal") > offset).drop("__ordinal").orderBy(*order)
    ordered = df.orderBy(*order)
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit else ordered


def events_page(events: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Oldest first."""
    return page(events, [F.col("created_at").asc(), F.col("id").asc()], limit, offset,
                F.date_trunc("hour", "created_at"))


def status_of(event_type: ColumnOrName) -> Column:
    kind = _c(event_type)
    return (
        F.when(kind == K.STARTED, "STARTED")
        .when(kind == K.FAILED, "FAILED")
        .when(kind == K.COMPLETED, "SUCCESS")
        .otherwise("UNSUPPORTED")
    )


def status_view(last: DataFrame, debug: bool = False) -> DataFrame:
    """Status of each execution with one nullable struct per status.

    Expects last events with a parsed ``payload``. Step metadata is part of the
    success view in debug mode only.
    """
    status = status_of("event_type")
    p = F.col("payload")
    steps = p["workflow_metadata"]
    return last.select(
        "execution_id",
        "organization_id",
        status.alias("status"),
        F.when(
            status == "STARTED",
            F.struct(
                "created_at",
                F.when(
                    p["s3_file_info"].isNotNull(),
                    F.struct(
                        p["s3_file_info"]["filename"].alias("file_name"),
                        p["s3_file_info"]["content_type"].alias("content_type"),
                        p["s3_file_info"]["presigned_url"].alias("presigned_url"),
                    ),
                ).alias("s3_file_info"),
                p["file_url"].alias("file_url"),
            ),
        ).alias("started"),
        F.when(
            status == "FAILED",
            F.struct(
                p["error_type"].alias("error_type"),
                p["failed_step"].alias("failed_step"),
                F.coalesce(p["retry_count"], F.lit(0)).alias("retry_count"),
                F.col("workflow_id"),
                p["error_message"].alias("error_message"),
            ),
        ).alias("failed"),
        F.when(
            status == "SUCCESS",
            F.struct(
                p["total_processing_time_ms"].alias("total_processing_time_ms"),
                p["final_result"].alias("result"),
                (steps if debug else F.when(F.lit(False), steps)).alias("workflow_metadata"),
            ),
        ).alias("success"),
    )


def await_result(
    events: DataFrame,
    timeout_s: int | None = None,
    cap_s: int = K.WAIT_CAP_SECONDS,
) -> DataFrame:
    """For every start event the first later result of its execution, or TIMEOUT.

    The wait is min(timeout or 30 s, cap). Time is cut into bands as long as the
    wait, so a result can only lie in the band of the start or in the next one: a
    window inside the band and one value carried back from the next band replace a
    range join, and no pair of events is ever built.
    """
    wait_us = min(timeout_s or K.WAIT_DEFAULT_SECONDS, cap_s) * 1_000_000
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    started = F.col("event_type") == K.STARTED
    hit = F.struct(
        micros.alias("us"), F.col("id").alias("id"), F.col("event_type").alias("type"),
        F.col("created_at").alias("at"),
    )
    banded = events.select(
        "execution_id", "id", "created_at", "event_type",
        micros.alias("us"),
        F.floor(micros / wait_us).alias("band"),
        F.when(~started, hit).alias("result"),
    )
    firsts = banded.groupBy("execution_id", "band").agg(F.min("result").alias("next_band"))
    previous_band = firsts.filter(F.col("next_band").isNotNull()).select(
        "execution_id", (F.col("band") - 1).alias("band"), "next_band"
    )
    # A result at the very instant of the start counts, whatever its id.
    tied = (
        Window.partitionBy("execution_id", "band")
        .orderBy(F.col("us").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_band = banded.withColumn("own", F.min("result").over(tied)).filter(
        F.col("event_type") == K.STARTED
    )
    found = F.coalesce(F.col("own"), F.col("next_band"))
    usable = F.when(found["us"] - F.col("us") <= wait_us, found)
    return (
        in_band.join(previous_band, ["execution_id", "band"], "left")
        .withColumn("hit", usable)
        .select(
            "execution_id",
            F.col("id").alias("start_id"),
            F.col("created_at").alias("started_at"),
            F.coalesce(status_of(F.col("hit.type")), F.lit("TIMEOUT")).alias("raw_status"),
            F.col("hit.id").alias("result_id"),
            F.col("hit.at").alias("result_at"),
        )
        .withColumn(
            "status", F.when(F.col("result_id").isNull(), "TIMEOUT").otherwise(F.col("raw_status"))
        )
        .withColumn(
            "code",
            F.when(F.col("status") == "TIMEOUT", 408)
            .when(F.col("status") == "UNSUPPORTED", 400)
            .otherwise(200),
        )
        .drop("raw_status")
    )


def redact_events(events: DataFrame, cutoff, rules: str = "payload") -> DataFrame:
    """Retention over flat event tables: due events are cleared and marked DONE.

    Events with a JSON ``event`` column have members of the payload cleared; a
    payload that cannot be edited keeps its text and gets the status ERROR.
    """
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    status = F.coalesce(F.col("anonymization_status"), F.lit("PENDING"))
    due = (F.col("created_at") <= limit) & (status == "PENDING")
    if "event" in events.columns:
        cleaned = redact_payload("event", "event_type", rules)
        return events.withColumns(
            {
                "event": F.when(due & cleaned.isNotNull(), cleaned).otherwise(F.col("event")),
                "anonymization_status": F.when(
                    due, F.when(cleaned.isNotNull(), "DONE").otherwise("ERROR")
                ).otherwise(status),
            }
        )
    columns = redaction_by_column(rules)
    hidden = {
        c: F.when(~(due & F.col("event_type").isin(*columns[c])), F.col(c))
        for c in events.columns
        if c in columns
    }
    return events.withColumns(
        {**hidden, "anonymization_status": F.when(due, "DONE").otherwise(status)}
    )

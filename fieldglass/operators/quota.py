"""Request counting against fixed windows of a minute and a day (UTC clock)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import constants as K
from .slices import AT, attach_summary, group_of, place


def request_ordinals(requests: DataFrame, key: str = "api_key") -> DataFrame:
    """Running number of each request of its key inside its minute and its day.

    Counted per second: a window numbers the requests inside one second, per-second
    totals place the second inside its minute and day. The busiest key costs one
    second of its traffic per task, plus 86 400 small rows per day.
    """
    timed = place(
        requests.withColumns(
            {"minute_start": F.date_trunc("minute", "ts"), "day_start": F.date_trunc("day", "ts")}
        ),
        [key],
        F.date_trunc("second", "ts"),
    )
    per_second = timed.groupBy(AT).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("minute_start").alias("m"),
        F.min("day_start").alias("d"),
    )

    def earlier(*within: str) -> WindowSpec:
        return (
            Window.partitionBy(*group_of([key]), *within)
            .orderBy(f"{AT}.slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    offsets = per_second.withColumns(
        {
            "before_minute": F.coalesce(F.sum("n").over(earlier("d", "m")), F.lit(0)),
            "before_day": F.coalesce(F.sum("n").over(earlier("d")), F.lit(0)),
        }
    )
    return (
        attach_summary(timed, offsets, ["before_minute", "before_day"])
        .withColumn("rn", F.row_number().over(Window.partitionBy(AT).orderBy("ts", "id")))
        .withColumn("minute_count", F.col("before_minute") + F.col("rn"))
        .withColumn("day_count", F.col("before_day") + F.col("rn"))
        .drop("before_minute", "before_day", "rn", AT)
    )


def verdict(ordinals: DataFrame, per_minute: int = K.LIMIT_PER_MINUTE,
            per_day: int = K.LIMIT_PER_DAY) -> DataFrame:
    """Decision per request. Denied requests keep counting; a limit is passed above it."""
    exceeded = (F.col("minute_count") > per_minute) | (F.col("day_count") > per_day)

    def left(limit: int, count: str) -> Column:
        return F.greatest(F.lit(0), F.lit(limit) - F.col(count))

    return ordinals.withColumns(
        {
            "allowed": ~exceeded,
            "remaining_minute": left(per_minute, "minute_count"),
            "remaining_day": left(per_day, "day_count"),
            "reset_minute": F.col("minute_start") + F.expr("INTERVAL 1 MINUTE"),
            "reset_day": F.col("day_start") + F.expr("INTERVAL 1 DAY"),
        }
    ).drop("minute_start", "day_start")


def usage_quota(requests: DataFrame, per_minute: int = K.LIMIT_PER_MINUTE,
                per_day: int = K.LIMIT_PER_DAY, key: str = "api_key") -> DataFrame:
    return verdict(request_ordinals(requests, key), per_minute, per_day)


def window_usage(requests: DataFrame, per_minute: int = K.LIMIT_PER_MINUTE,
                 per_day: int = K.LIMIT_PER_DAY, key: str = "api_key") -> DataFrame:
    """Totals per key and window of both sizes, with what is left and the overrun.

    Minutes are counted from the rows, days from the minutes: one pass over the data.
    """
    minutes = requests.groupBy(key, F.date_trunc("minute", "ts").alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    days = minutes.groupBy(key, F.date_trunc("day", "window_start").alias("window_start")).agg(
        F.sum("requests").alias("requests")
    )

    def sized(df: DataFrame, size: str, limit: int) -> DataFrame:
        return df.select(
            key,
            F.lit(size).alias("window_size"),
            "window_start",
            "requests",
            F.greatest(F.lit(0), limit - F.col("requests")).alias("remaining"),
            F.greatest(F.lit(0), F.col("requests") - limit).alias("denied"),
        )

    return sized(minutes, "minute", per_minute).unionByName(sized(days, "day", per_day))

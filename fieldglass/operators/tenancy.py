"""Organizations, API keys, webhooks and the notifications they receive.

No join is hinted: the tables of a tenant registry may grow, so Catalyst and AQE
pick a broadcast from measured sizes and fall back to skew-aware sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.protect import merge_headers
from .events import last_event, page
from .slices import chunked_lists, header_and_items


def keys_with_organization(keys: DataFrame, organizations: DataFrame) -> DataFrame:
    """API keys with the columns of their organization, null when it is missing."""
    orgs = organizations.select(
        F.col("id").alias("organization_id"),
        F.col("name").alias("organization_name"),
        "platform_role",
    )
    return keys.join(orgs, "organization_id", "left")


def organization_with_keys(organizations: DataFrame, keys: DataFrame,
                           slice_by: Column, chunk_rows: int = 1000) -> DataFrame:
    """Organizations with their keys as an ordered list, in chunks of ``chunk_rows``."""
    nested = chunked_lists(
        keys.filter(F.col("organization_id").isNotNull()),
        ["organization_id"],
        [F.col("id")],
        slice_by,
        F.struct("id", "prefix", "status"),
        "api_keys",
        chunk_rows,
    )
    return (
        organizations.join(
            nested.withColumnRenamed("organization_id", "__org"),
            organizations["id"] == F.col("__org"),
            "left",
        )
        .drop("__org")
        .withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    )


def organization_key_items(organizations: DataFrame, keys: DataFrame, slice_by: Column) -> tuple[DataFrame, DataFrame]:
    """Every organization with the number of its keys, and one row per key in order of id."""
    owned = keys.filter(F.col("organization_id").isNotNull()).select("organization_id", "id", "prefix", "status")
    counted, items = header_and_items(owned, ["organization_id"], [F.col("id")], slice_by)
    header = organizations.join(counted.withColumnRenamed("organization_id", "__org"), organizations["id"] == F.col("__org"), "left")
    return header.drop("__org").withColumn("items", F.coalesce("items", F.lit(0))), items


def active_key_by_prefix(keys: DataFrame, prefix: str | None = None) -> DataFrame:
    found = keys.filter(F.col("status") == K.KEY_STATUSES[0])
    return found if prefix is None else found.filter(F.col("prefix") == prefix)


def by_organization(rows: DataFrame, organization, row_id=None) -> DataFrame:
    found = rows.filter(F.col("organization_id") == organization)
    return found if row_id is None else found.filter(F.col("id") == row_id)


def platform_admins(keys_with_org: DataFrame) -> DataFrame:
    return keys_with_org.filter(F.col("platform_role") == K.ADMIN_ROLE)


def listing(rows: DataFrame, limit: int | None = None, offset: int = 0,
            created: str = "created_at") -> DataFrame:
    return page(rows, [F.col(created).asc(), F.col("id").asc()], limit, offset)


def webhook_fanout(finished: DataFrame, webhooks: DataFrame) -> DataFrame:
    """One message per finished execution and webhook of its organization."""
    hooks = webhooks.select(F.col("id").alias("webhook_id"), "organization_id", "url")
    return finished.join(hooks, "organization_id")


def finished_to_notify(results: DataFrame) -> DataFrame:
    """Finished executions worth a notification: not those that will be retried."""
    retried = (F.col("error_type") == K.RETRYABLE_ERROR) & ~F.col("is_last_retry")
    return results.filter(F.col("organization_id").isNotNull() & ~F.coalesce(retried, F.lit(False)))


def resolve_notifications(messages: DataFrame, webhooks: DataFrame, events: DataFrame,
                          event_keys: bool = True) -> DataFrame:
    """Messages with webhook and last event; ``error`` names what was not found.

    Only the log of executions that have a message is reduced to last events.
    """
    if event_keys:
        wanted = messages.select("execution_id").distinct()
        events = last_event(events.join(wanted, "execution_id", "left_semi"))
    hooks = webhooks.select(
        F.col("id").alias("webhook_id"), "url",
        *(["headers"] if "headers" in webhooks.columns else []),
        F.lit(True).alias("__hook"),
    )
    lasts = events.select(
        "execution_id",
        F.col("id").alias("event_id"),
        "event_type",
        F.lit(True).alias("__event"),
    )
    joined = messages.join(hooks, "webhook_id", "left").join(lasts, "execution_id", "left")
    error = F.when(
        F.col("__hook").isNull(),
        F.concat(F.lit("WebHook not found: "), F.coalesce(F.col("webhook_id").cast("string"), F.lit(""))),
    ).when(
        F.col("__event").isNull(),
        F.concat(F.lit("Event not found: "), F.coalesce("execution_id", F.lit(""))),
    )
    out = joined.withColumn("error", error).drop("__hook", "__event")
    if "headers" in out.columns:
        out = out.withColumn("headers", merge_headers("headers"))
    return out

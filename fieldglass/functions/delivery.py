"""Message decoding, retry decisions, key formats and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numbers import ColumnOrName, _c


def decode_message(data: ColumnOrName, keys: tuple[str, ...], exact: bool) -> Column:
    """Map of the message members, or null when the text is not a usable message.

    ``exact`` rejects extra members; otherwise the named ones only have to exist.
    """
    members = F.from_json(_c(data), "map<string,string>", {"mode": "PERMISSIVE"})
    valid_json = F.try_parse_json(_c(data)).isNotNull()
    wanted = F.array(*[F.lit(k) for k in keys])
    complete = F.size(F.array_except(wanted, F.map_keys(members))) == 0
    if exact:
        complete = complete & (F.size(F.map_keys(members)) == len(keys))
    return F.when(valid_json & complete, members)


def is_last_retry(retries: ColumnOrName, max_deliveries: int = K.MAX_DELIVERIES) -> Column:
    return _c(retries) >= max_deliveries - 1


def route(outcome: ColumnOrName, retries: ColumnOrName, decoded: Column,
          max_deliveries: int = K.MAX_DELIVERIES) -> Column:
    """struct(route, reason, next_retries): ack, requeue or dead letter.

    ``outcome`` is success, retryable or anything else (fatal); a message that did
    not decode never reaches the outcome.
    """
    result, count = _c(outcome), F.coalesce(_c(retries), F.lit(0))
    requeue = (result == "retryable") & ~is_last_retry(count, max_deliveries)
    reason = (
        F.when(~decoded, "decode_error")
        .when(result == "success", F.lit(None))
        .when(requeue, F.lit(None))
        .when(result == "retryable", "max_retries_exceeded")
        .otherwise("not_retryable_error")
    )
    return F.struct(
        F.when(reason.isNotNull(), "dlq").when(result == "success", "ack").otherwise("requeue")
        .alias("route"),
        reason.alias("reason"),
        F.when(reason.isNull() & requeue, count + 1).alias("next_retries"),
    )


def http_retryable(status: ColumnOrName) -> Column:
    code = _c(status)
    return F.coalesce(~code.isin(*K.NOT_RETRYABLE_HTTP) & code.between(400, 599), F.lit(False))


def backoff_seconds(attempt: ColumnOrName) -> Column:
    return K.BACKOFF_SECONDS * F.pow(F.lit(K.BACKOFF_FACTOR), _c(attempt).cast("double"))


def key_prefix(presented: ColumnOrName) -> Column:
    """Prefix part of a well-formed API key, null for any other text."""
    env = "|".join(K.KEY_ENVIRONMENTS)
    shape = rf"^dia_(?:{env})_v?\d+_([A-Z2-7]{{8}})_[A-Z2-7]{{40,64}}_[A-Z2-7]{{4}}$"
    return F.nullif(F.regexp_extract(_c(presented), shape, 1), F.lit(""))


def classify_error(error_type: ColumnOrName, inner_type: ColumnOrName,
                   failed_step: ColumnOrName) -> Column:
    """struct(error_type, failed_step, retryable); the inner error is the one reported."""
    kind = F.coalesce(_c(inner_type), _c(error_type))
    return F.struct(
        kind.alias("error_type"),
        F.coalesce(_c(failed_step), F.lit(K.UNKNOWN_STEP)).alias("failed_step"),
        F.coalesce(kind == K.RETRYABLE_ERROR, F.lit(False)).alias("retryable"),
    )


def parse_metadata(text: ColumnOrName) -> Column:
    """struct(metadata, error): nothing given is an empty object, empty JSON is an error."""
    raw = _c(text)
    parsed = F.try_parse_json(raw)
    blank = raw.isNull() | (raw == "")
    falsy = F.regexp_replace(raw, r"\s+", "").isin("{}", "[]", "null", '""', "0", "0.0", "false")
    error = (
        F.when(blank, F.lit(None))
        .when(parsed.isNull(), "Invalid JSON format in metadata")
        .when(falsy, "Metadata cannot be empty")
    )
    return F.struct(
        F.when(blank, "{}").when(error.isNull(), raw).alias("metadata"), error.alias("error")
    )

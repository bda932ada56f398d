"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from . import (  # noqa: F401 - importing registers the queries
    all_types,
    evaluation,
    event_log,
    experiments,
    files_and_labels,
    messages,
    pages_and_logs,
    scalars,
    stored,
    streams,
    tenants,
    user_code,
)
from .registry import oracles, queries

__all__ = ["queries", "oracles"]

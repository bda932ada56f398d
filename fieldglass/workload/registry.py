"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, Inputs

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the derived views of ``views`` by name."""

    def keep(build: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))

    return {name: bind(build) for name, build in _QUERIES.items()}


def oracles() -> dict[str, str]:
    """SQL twins with the views they use as common table expressions."""
    return {name: _with_views(sql) for name, sql in _SQL.items()}


def _with_views(sql: str) -> str:
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in used and _mentions(text, name):
                need(body)
                used.append(name)

    need(sql)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE) is not None

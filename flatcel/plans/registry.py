"""Registered queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flatcel.plans.adapters import Views, VIEW_SQL
from flatcel.session import ship_package

Query = Callable[[Views], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the adapter views."""

    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _with_views(sql: str) -> str:
    """Prepend the views a statement mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in needed)
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{stripped[len('WITH RECURSIVE'):]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {head},\n{stripped[len('WITH'):]}"
    return f"WITH {head}\n{stripped}"


def load() -> None:
    from flatcel.plans import (  # noqa: F401
        q_assets,
        q_colors,
        q_documents,
        q_export,
        q_matching,
        q_pixels,
        q_regions,
        q_sequences,
        q_timeline,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Views(spark, sf_dir))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    load()
    return {name: _with_views(sql) for name, sql in _SQL.items()}

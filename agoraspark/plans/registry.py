"""Name → query, and name → SQL, over all themes."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

THEMES = ("events", "aggregates", "joins", "windows", "ledgers", "vectors", "search", "incremental", "recommend", "relevance", "content", "access", "records")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in THEMES:
        found = getattr(import_module(f"agoraspark.plans.{name}").theme, attribute)
        if clash := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("sql")

"""Queries over the canonical views, each with equal SQL for the checks where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Views`` as a query; ``sql`` names views in braces."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def registered() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from . import aggregates, areas, evaluation, fusion, joins, measures, rules, scans, signals, site, store, windows  # noqa: F401

    return dict(_QUERIES), dict(_SQL)

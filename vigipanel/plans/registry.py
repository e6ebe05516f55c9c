"""Registered queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
COMPARISON: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame``; ``views`` are the input views of one folder."""

    def register(fn):
        from vigipanel.plans.views import Views

        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            from vigipanel.plans.comparison_views import with_views

            COMPARISON[name] = with_views(sql)
        return fn

    return register

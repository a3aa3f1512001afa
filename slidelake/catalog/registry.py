"""All registered queries with their SQL twins."""

from __future__ import annotations

import importlib

from slidelake.catalog.fixtures import Query

_MODULES = ("manifest_queries", "tiling_queries", "token_queries", "metric_queries", "source_queries")


def registry() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name in _MODULES:
        out |= importlib.import_module(f"slidelake.catalog.{name}").QUERIES
    return out

"""Registered queries, each beside the SQL that another engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``oracle`` may use {relation} of ``derived``."""

    def add(f):
        from ..sources.derived import with_relations

        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_relations(oracle)
        return f

    return add

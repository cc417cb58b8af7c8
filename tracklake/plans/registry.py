"""Registry of the queries that run on the star-schema tables, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklake.sources.library import DERIVED, StarLibrary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_SHARED = dict(DERIVED)


def shared(name: str, sql: str) -> None:
    """A further named sub-query the oracle texts may refer to."""
    _SHARED[name] = sql


def oracle_text(body: str) -> str:
    """``body`` with the definitions of all derived tables it mentions, directly or through one another."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _SHARED:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(_SHARED[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    shared_text = ",\n".join(f"{n} AS ({_SHARED[n]})" for n in needed)
    own = "WITH RECURSIVE"
    if body.lstrip().startswith(own):  # the query brings definitions of its own
        return f"{own} {shared_text},\n" + body.lstrip()[len(own):]
    return f"WITH {shared_text}\n{body}"


def query(sql: str | None = None):
    """Register a function (library) -> DataFrame under its own name."""

    def register(fn: Callable[[StarLibrary], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, path: fn(StarLibrary(spark, path))
        if sql is not None:
            ORACLE[fn.__name__] = oracle_text(sql)
        return fn

    return register

"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where one can be written, the equivalent DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import re

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op: str  # SURVEY inventory id(s)


REGISTRY: dict[str, QuerySpec] = {}


def _duck_quote(sql: str | None) -> str | None:
    """``column`` is reserved in DuckDB; quote it as an identifier."""
    if sql is None:
        return None
    return re.sub(r'(?<![\w"])column(?![\w"])', '"column"', sql)


def register(name: str, op: str, sql: str | None = None):
    sql = _duck_quote(sql)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, op)
        return fn

    return deco


def load_all() -> dict[str, QuerySpec]:
    # importing the modules registers their queries; the model fits (the heaviest,
    # rows-only checks) come last
    from tabforge.plans import (  # noqa: F401
        q_sources,
        q_infer,
        q_profile,
        q_features,
        q_encode,
        q_blend,
        q_text,
        q_closed,
        q_solve,
        q_models,
    )

    return REGISTRY

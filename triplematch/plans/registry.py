"""Registry of named queries over the driver tables, each with an optional DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``ops`` lists the operator ids it exercises."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills the registry.
    from triplematch.plans import annotation, bio, corpus, dependency, dialogue, evaluation, readers  # noqa: F401
    return REGISTRY

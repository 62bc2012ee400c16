"""Registry of runnable queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans.bindings import Bound

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Bound], DataFrame]], Callable[[Bound], DataFrame]]:
    """Register a function of the bound tables under ``name``."""

    def register(build: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Bound(spark, sf_dir))

        _QUERIES[name] = Query(run, sql)
        return build

    return register


def all_queries() -> dict[str, Query]:
    """Every query, importing the modules that register them."""
    from folioflow.plans import (  # noqa: F401
        documents,
        grouping,
        joining,
        listing,
        modelling,
        predicates,
        recommend,
        retrieval,
        scalars,
        scans,
        streams,
    )

    return dict(_QUERIES)

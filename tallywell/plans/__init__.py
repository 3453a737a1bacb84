"""Query keys: each module has queries() and oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywell.plans import analytics, jobs, metrics, pictures, service, store, streams

MODULES = (analytics, metrics, store, service, jobs, streams, pictures)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}

"""Query registry: each registered query reads the driver tables under
``sf_dir`` and returns a DataFrame; most carry a DuckDB oracle SQL string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    import importlib

    # Imported for their side effect: registration.
    for mod in MODULES:
        importlib.import_module(f"tendermatch.plans.{mod}")


MODULES = ["numeric_queries", "categorical_queries", "lookup_queries", "pair_queries", "matching_queries", "text_queries", "store_queries", "table_queries", "stream_queries"]

"""Name -> (query, oracle SQL) of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater import session

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
FLAGSHIP = "search_bm25_relevance"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is DuckDB SQL over the same tables."""

    def add(build: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: build(session.tune(spark), sf_dir)
        if oracle:
            _ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from tidewater import plans  # noqa: F401  each module registers its queries


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES

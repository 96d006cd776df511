"""All registered queries of the billing operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remitspark.views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the views as a query, with its SQL where that can express it."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    from remitspark.plans import load

    load()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rul_03_amount_outlier"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Name -> query and name -> SQL of every registered query outside the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "a01_errors_by_type"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_all: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in _all:
            raise ValueError(f"{name} is registered twice")
        _all[name] = Query(name, f, sql)
        return f

    return add


def load() -> dict[str, Query]:
    from vellumspark.plans import modules

    modules.load()
    return _all


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in load().values()}


def oracles() -> dict[str, str]:
    return {q.name: q.sql for q in load().values() if q.sql}

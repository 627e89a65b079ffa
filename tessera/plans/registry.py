"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import make_importable, spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module by the names of their functions."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table; the texts of a small one are dealt to all cores."""
    rows = make_importable(spark).read.parquet(f"{at}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows

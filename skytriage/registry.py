"""A module's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return keep


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for output; -0.0 becomes 0.0."""

    def out(name: str, kind: str) -> Column:
        return (F.round(name, places) + F.lit(0.0)).alias(name) if kind == "double" and name not in keep else F.col(name)

    return df.select(*(out(n, k) for n, k in df.dtypes))

"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import canonical, oracle


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, minus zero as zero: sums differ in order between engines."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


class Book:
    """Queries and oracles of a module."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, f: Callable, sql: str | None = None, *ctes: str) -> None:
        """f takes the canonical tables; sql selects from the views (and ctes)."""
        self.queries[name] = lambda spark, d: tidy(f(canonical(spark, d)))
        if sql:
            self.oracles[name] = oracle(sql, *ctes)

    def add_raw(self, name: str, f: Callable, sql: str | None = None) -> None:
        """f takes (spark, sf_dir)."""
        self.queries[name] = lambda spark, d: tidy(f(spark, d))
        if sql:
            self.oracles[name] = sql

"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return order


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(
    name: str,
    sql: str | None = None,
    views: tuple[str, ...] = (),
    doubles: tuple[str, ...] = (),
    digits: int = 6,
):
    """Registers a query. Float columns are rounded on both sides, because float
    sums depend on the order of addition."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: _rounded(fn(spark, sf), digits)
        if sql is not None:
            ctes = [f"{v} AS ({VIEW_SQL[v][1]})" for v in _needed(views)]
            ctes.append(f"answer AS ({sql})")
            keep = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles)
            star = f"* REPLACE ({keep})" if keep else "*"
            CHECKS[name] = f"WITH {', '.join(ctes)} SELECT {star} FROM answer"
        return fn

    return wrap

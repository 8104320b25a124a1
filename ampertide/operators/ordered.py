"""Ordered operations that stay parallel inside one key.

A plain window puts a whole key in one task. Where a key has no natural bound,
the caller passes a *cell*: a column that never decreases along the order (a
price band, a day). Work runs per (key, cell); one small row per cell then
carries the state from cell to cell, and the result is the exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the key columns of the left side stay."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = None
    for c in on:
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`"))
        match = same if match is None else match & same
    return left.join(other, match, how).drop(*[f"_r_{c}" for c in on])


def nearest_known(
    df: DataFrame, keys: list[str], order: str, value: str, cell: Column | None = None
) -> DataFrame:
    """Adds prev_/next_<value>: the last non-null value at or before the row and
    the first at or after it. Rows of equal order see each other.

    Without a cell each key is one window: only for keys of bounded size."""
    # Both sides are growing frames from the start of an order: a frame that shrinks
    # towards the end is evaluated anew for every row.
    past = (W.unboundedPreceding, W.currentRow)
    known_last = F.last(value, ignorenulls=True)
    if cell is None:
        w = W.partitionBy(*keys)
        return df.select(
            "*",
            known_last.over(w.orderBy(order).rangeBetween(*past)).alias(f"prev_{value}"),
            known_last.over(w.orderBy(F.desc(order)).rangeBetween(*past)).alias(f"next_{value}"),
        )
    d = df.withColumn("_cell", cell)
    here = W.partitionBy(*keys, "_cell")
    local = d.select(
        "*",
        known_last.over(here.orderBy(order).rangeBetween(*past)).alias("_p"),
        known_last.over(here.orderBy(F.desc(order)).rangeBetween(*past)).alias("_n"),
    )
    # The edge values of each cell, then their carry over the cells of the key.
    known = d.filter(F.col(value).isNotNull())
    edges = known.groupBy(*keys, "_cell").agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last")
    )
    slots = join_null_safe(d.select(*keys, "_cell").distinct(), edges, [*keys, "_cell"], "left")
    w = W.partitionBy(*keys)
    earlier = (W.unboundedPreceding, -1)
    carry = slots.select(
        *keys,
        "_cell",
        F.last("_last", ignorenulls=True).over(w.orderBy("_cell").rowsBetween(*earlier)).alias("_cp"),
        F.last("_first", ignorenulls=True).over(w.orderBy(F.desc("_cell")).rowsBetween(*earlier)).alias("_cn"),
    )
    return join_null_safe(local, carry, [*keys, "_cell"]).select(
        *df.columns,
        F.coalesce("_p", "_cp").alias(f"prev_{value}"),
        F.coalesce("_n", "_cn").alias(f"next_{value}"),
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], cell: Column
) -> DataFrame:
    """Adds cum_<v> (inclusive running sums) and tot_<v> (sums of the key)."""
    d = df.withColumn("_cell", cell)
    here = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(v).over(here).alias(f"_c_{v}") for v in values])
    sums = d.groupBy(*keys, "_cell").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    w = W.partitionBy(*keys)
    before = w.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(
        *keys,
        "_cell",
        *[F.sum(f"_s_{v}").over(before).alias(f"_b_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(w).alias(f"tot_{v}") for v in values],
    )
    return join_null_safe(local, carry, [*keys, "_cell"]).select(
        *df.columns,
        *[(F.col(f"_c_{v}") + F.coalesce(f"_b_{v}", F.lit(0))).alias(f"cum_{v}") for v in values],
        *[f"tot_{v}" for v in values],
    )


def row_index(df: DataFrame, keys: list[str], order: list[str], cell: Column) -> DataFrame:
    """Adds _idx: 0,1,2,... per key along the order."""
    d = running_total(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"], cell)
    return d.select(*df.columns, (F.col("cum__one") - 1).alias("_idx"))


def halo_blocks(df: DataFrame, reach: int, block: int, index: str = "_idx") -> DataFrame:
    """Cuts indexed rows into blocks of `block` rows and copies into each the
    `reach` rows before it, marked _halo. A row lands in 1 + reach/block blocks."""
    i = F.col(index)
    own = F.floor(i / block)
    last = F.floor((i + reach) / block)
    return df.select("*", F.explode(F.sequence(own, last)).alias("_block")).withColumn(
        "_halo", F.col("_block") != F.floor(i / block)
    )


def trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reach: int,
    cell: Column,
    columns: dict[str, object],
    block: int = 4096,
) -> DataFrame:
    """Window columns over at most `reach` rows back, without a window that holds a
    whole key. `columns` maps names to functions of an ordered window spec."""
    indexed = row_index(df, keys, order, cell)
    blocks = halo_blocks(indexed, reach, max(block, reach))
    w = W.partitionBy(*keys, "_block").orderBy("_idx")
    out = blocks.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return out.filter(~F.col("_halo")).drop("_block", "_halo")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order, as one ordered aggregate."""
    from .tape import dedupe

    return dedupe(df, keys, order)

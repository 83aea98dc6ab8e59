"""Ordered computations per key that stay parallel inside one key.

A window over a key runs in one task, which fails when one key holds a large share of the rows. Here rows are
range-partitioned on (key, order), so that a large key spans many cells (key, partition). Each cell is folded on its
own; what a cell needs from earlier cells of its key is a small carry row. Only a key that crosses a partition border
has carries, so there are fewer carry rows than partitions: that bound is what makes their broadcast safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import cut

CELL = "_cell"


def cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows with their cell number, increasing in `order` within a key; written once, as it is read twice."""
    how_many = [parts] if parts else []  # unset: adaptive execution sizes the ranges
    spread = df.repartitionByRange(*how_many, *keys, *order).withColumn(CELL, F.spark_partition_id())
    return cut(spread)


def _last_by(value: str, order: Sequence[str]) -> Column:
    return F.max_by(F.col(value), F.struct(*order))


def crossing(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary rows of keys that span several cells."""
    spans = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return summary.withColumn("_spans", spans).filter("_spans > 1").drop("_spans")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    reset: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running sum or max of each measure up to the row, restarting at every row where `reset` holds.

    `measures` maps an output column to ("sum" | "max", value). `order` must be unique within a key.
    The reset row itself belongs to the new run.
    """
    reset = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    merge = {"sum": F.sum, "max": F.max}
    inputs = df.withColumn("_reset", reset.cast("int"))
    for name, (_, value) in measures.items():
        inputs = inputs.withColumn(f"_in_{name}", value)
    spread = cells(inputs, keys, order, parts)

    in_cell = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn("_run", F.sum("_reset").over(in_cell))
    in_run = Window.partitionBy(*keys, CELL, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, (how, _) in measures.items():
        local = local.withColumn(f"_own_{name}", merge[how](f"_in_{name}").over(in_run))

    ends = local.groupBy(*keys, CELL).agg(
        F.max("_run").alias("_runs"), *[_last_by(f"_own_{n}", order).alias(f"_end_{n}") for n in measures]
    )
    by_cell = Window.partitionBy(*keys).orderBy(CELL)
    so_far = by_cell.rowsBetween(Window.unboundedPreceding, 0)
    carry = crossing(ends, keys).withColumn(
        "_group", F.sum((F.col("_runs") > 0).cast("int")).over(so_far)
    )
    in_group = Window.partitionBy(*keys, "_group").orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0)
    for name, (how, _) in measures.items():
        carry = carry.withColumn(f"_out_{name}", merge[how](f"_end_{name}").over(in_group))
    carry = carry.select(*keys, CELL, *[F.lag(f"_out_{n}").over(by_cell).alias(f"_carry_{n}") for n in measures])

    joined = with_carry(local, carry, keys)
    for name, (how, _) in measures.items():
        own, before = F.col(f"_own_{name}"), F.col(f"_carry_{name}")
        if how == "sum":
            whole = F.when(own.isNull() & before.isNull(), None).otherwise(
                F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
        else:
            whole = F.greatest(own, before)
        joined = joined.withColumn(name, F.when(F.col("_run") == 0, whole).otherwise(own))
    return joined.select(*df.columns, *measures)


def with_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fewer carry rows than range partitions exist, hence the broadcast."""
    renamed = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CELL).alias("_k_cell"),
                           *[c for c in carry.columns if c not in keys and c != CELL])
    same = F.col(CELL) == F.col("_k_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(F.broadcast(renamed), same, "left")


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], parts: int | None = None
) -> DataFrame:
    """`lag` of columns over (keys, order): output name -> input column."""
    spread = cells(df, keys, order, parts)
    in_cell = Window.partitionBy(*keys, CELL).orderBy(*order)
    local = spread.withColumn("_first", F.row_number().over(in_cell) == 1)
    for name, source in values.items():
        local = local.withColumn(f"_own_{name}", F.lag(source).over(in_cell))
    ends = spread.groupBy(*keys, CELL).agg(*[_last_by(s, order).alias(f"_end_{n}") for n, s in values.items()])
    by_cell = Window.partitionBy(*keys).orderBy(CELL)
    carry = crossing(ends, keys).select(
        *keys, CELL, *[F.lag(f"_end_{n}").over(by_cell).alias(f"_carry_{n}") for n in values]
    )
    joined = with_carry(local, carry, keys)
    for name in values:
        joined = joined.withColumn(
            name, F.when(F.col("_first"), F.col(f"_carry_{name}")).otherwise(F.col(f"_own_{name}"))
        )
    return joined.select(*df.columns, *values)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """`row_number` over (keys, order) without one task per key."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, parts=parts)

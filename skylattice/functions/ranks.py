"""Ranks and running numbers of groups of any size.

A window over a group sorts the whole group in one task. Here the rows are cut into ranges of their order, over
all groups at once; a window runs inside a range, and what lies in the ranges before is a running sum
over one count per range. Only the group that goes on from the range before needs it: that is one at
most per range, which bounds the table of starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.session import materialize


def _in_ranges(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """``df`` and ``_b``, the number of its range in the order of (keys, order); written, so that the ranges stay as they are."""
    return materialize(df.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id()), "ranges")


def _with_start(placed: DataFrame, keys: tuple[str, ...], weight: Column) -> DataFrame:
    """Adds ``_start``: the weight of the row's group in the ranges before."""
    totals = placed.groupBy(*keys, "_b").agg(F.sum(weight).alias("_t"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.sum("_t").over(run)).where("_start > 0")
    starts = starts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_b").alias("_of__b"), "_start")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_b")])
    joined = placed.join(F.broadcast(starts), same, "left")
    return joined.withColumn("_start", F.coalesce("_start", F.lit(0))).drop(*[f"_of_{k}" for k in (*keys, "_b")])


def value_ranks(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, value, n_equal, n_below): how often each value occurs and how many rows lie below it."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_equal"))
    placed = _in_ranges(counted, keys, value)
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_equal").over(inside), F.lit(0))
    return _with_start(placed.withColumn("_before", before), keys, F.col("n_equal")).select(*keys, value, "n_equal", (F.col("_start") + F.col("_before")).alias("n_below"))


def average_rank(df: DataFrame, keys: tuple[str, ...], value: str, output: str) -> DataFrame:
    """Adds the average rank (1-based, ties share their mean) of ``value`` in its group."""
    r = value_ranks(df, keys, value)
    return df.join(r, [*keys, value]).withColumn(output, F.col("n_below") + (F.col("n_equal") + 1) / 2.0).drop("n_below", "n_equal")


def numbered(df: DataFrame, keys: tuple[str, ...], order: str, output: str) -> DataFrame:
    """Adds a dense 0-based number by ``order``, which must be unique within the group."""
    placed = _in_ranges(df, keys, order)
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    started = _with_start(placed.withColumn("_i", F.row_number().over(inside) - 1), keys, F.lit(1))
    return started.select(*df.columns, (F.col("_start") + F.col("_i")).alias(output))


def running_sums(df: DataFrame, order: str, weights: tuple[str, ...]) -> DataFrame:
    """Adds ``<weight>_upto``: the sum of each weight over the rows up to this one by ``order``, which must be unique."""
    placed = _in_ranges(df, (), order)
    totals = placed.groupBy("_b").agg(*[F.sum(w).alias(w) for w in weights])
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_b", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_start_{w}") for w in weights])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    started = placed.join(F.broadcast(starts), "_b")
    return started.select(*df.columns, *[(F.col(f"_start_{w}") + F.sum(w).over(inside)).alias(f"{w}_upto") for w in weights])

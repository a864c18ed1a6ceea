"""Joins of large rows with one small row per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
BROADCAST_ROWS = 100_000


def salted_join(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], salt_on: Sequence[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join group-level values onto rows without sending a whole group to one task.

    Rows are dealt by a hash of ``salt_on`` within their group and every group row is copied
    once per salt. A group that holds a third of the data is spread over ``salts`` tasks, and
    an aggregation that follows cannot reuse a partitioning by the bare key. Where the group
    table is small enough the planner broadcasts it and nothing is shuffled.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    right = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_single_row(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Rows with the columns of a one-row frame beside them.

    ``single`` must be an ungrouped aggregate, which bounds what is broadcast to one row.
    """
    one = single.withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def lookup_join(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], salt_on: Sequence[str], most: int) -> DataFrame:
    """Rows of the groups in ``per_group``, with its columns; NULL keys meet NULL.

    ``per_group`` has one short row per group, ``most`` rows at most by count: up to ``BROADCAST_ROWS`` go to every
    task and ``rows`` stay where they are; a longer table is joined by salted keys.
    """
    named = per_group.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in per_group.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    if most <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(named), same)
    else:
        left = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
        right = named.withColumn("_of__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, same & (F.col("_salt") == F.col("_of__salt"))).drop("_salt", "_of__salt")
    return joined.drop(*[f"_of_{k}" for k in keys])

"""Joins that stay balanced when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that count as hot; as their weights add up to the total, no more than this many can be.
HOT = 4096


def join_weighted(rows: DataFrame, dim: DataFrame, key: str | list[str], weight: str, total: int, hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``dim``, one row a ``key``, whose ``weight`` counts the key's rows.

    ``total`` is the sum of the weights. Keys with at least ``total / hot`` rows are at most ``hot``
    many, so that part of ``dim`` is broadcast whatever the data's size; all others are shuffled and
    none of them has more than that share. ``rows`` is read twice and should be a written table.
    """
    heavy = dim.filter(F.col(weight) * hot >= total)
    light = dim.filter(F.col(weight) * hot < total)
    some = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return some.unionByName(rest)


def keyed_counts(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows of each non-null key, counted before the shuffle."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(weight))


def partitions_for(spark: SparkSession, rows: int, each: int = 2_000_000) -> int:
    """How many partitions so many small rows are shuffled to by hand: the session's number, or more where each would hold too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))

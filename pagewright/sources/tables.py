"""Reading the tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table whose rows cost much work each: a scan of fewer splits than there are cores is parted further.

    Large tables have more splits than that and are read where they lie, without a shuffle.
    """
    rows, cores = table(spark, directory, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

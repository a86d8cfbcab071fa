"""Orders over whole tables without gathering them in one task."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantile cuts asked for at least, and at most, which bounds what reaches the driver; rows a cut between.
CUTS, MOST_CUTS = 256, 8192
ROWS = 1_000_000


def cuts_for(rows: int) -> int:
    """How many buckets a table of so many rows is parted into."""
    return min(MOST_CUTS, max(CUTS, rows // ROWS))


def split_points(df: DataFrame, column: str, cuts: int | None = None) -> tuple[list[float], list[float]]:
    """Bucket borders from approximate quantiles, and the heavy values among them.

    A value that fills more than one quantile is heavy; it gets a bucket of its own, so every other
    bucket holds about 1/``cuts`` of the rows. At most ``2 * cuts + 2`` borders are returned. ``cuts``
    goes by the number of rows unless given.
    """
    cuts = cuts or cuts_for(df.count())
    probs = [i / cuts for i in range(cuts + 1)]
    found = df.select(F.percentile_approx(F.col(column).cast("double"), probs, 10 * cuts)).first()[0]
    if not found:
        return [-np.inf, np.inf], []
    values, times = np.unique(np.asarray(found, dtype="float64"), return_counts=True)
    heavy = values[times > 1]
    borders = np.unique(np.concatenate([values, heavy, np.nextafter(heavy, np.inf)]))
    return [-np.inf, *borders[np.isfinite(borders)].tolist(), np.inf], heavy.tolist()


def _bucketed(df: DataFrame, column: str, borders: list[float], out: str) -> DataFrame:
    if len(borders) < 3:
        return df.withColumn(out, F.lit(0.0))
    work = df.withColumn("_at", F.col(column).cast("double"))
    return Bucketizer(splits=borders, inputCol="_at", outputCol=out, handleInvalid="keep").transform(work).drop("_at")


def counts_above(df: DataFrame, column: str) -> DataFrame:
    """For each distinct non-null value: ``value, ties, above``.

    ``ties`` is the number of rows with the value, ``above`` that of rows with a strictly greater
    one. Values are counted first, so ties never gather; cumulative sums run in quantile buckets
    and the buckets' totals, at most ``2 * MOST_CUTS + 2``, are summed up by themselves.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    borders, _ = split_points(df.filter(F.col(column).isNotNull()), column)
    placed = _bucketed(values, "value", borders, "_b")
    totals = placed.groupBy("_b").agg(F.sum("ties").alias("_n"))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_over"))
    inside = Window.partitionBy("_b").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("ties").over(inside), F.lit(0))
    return placed.join(F.broadcast(offsets), "_b").select("value", "ties", (F.col("_over") + within).alias("above"))


def global_row_number(df: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """Number all rows from 1 by ``score`` descending, then ``tie`` ascending.

    Equal to ``row_number`` over one window, but each task sorts one quantile bucket only; a score
    shared by many rows is further split by quantiles of ``tie``. ``score`` must not be null and
    ``tie`` should be unique; both are read as numbers.
    """
    borders, heavy = split_points(df, score)
    placed = _bucketed(df, score, borders, "_b")
    if heavy:
        placed = _bucketed(placed, tie, split_points(df, tie)[0], "_t")
        placed = placed.withColumn("_t", F.when(F.col(score).isin(heavy), F.col("_t")).otherwise(F.lit(0.0)))
    else:
        placed = placed.withColumn("_t", F.lit(0.0))
    totals = placed.groupBy("_b", "_t").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(F.desc("_b"), "_t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", "_t", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_over"))
    inside = Window.partitionBy("_b", "_t").orderBy(F.desc(score), tie)
    numbered = placed.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), ["_b", "_t"])
    return numbered.withColumn(out, F.col("_over") + F.col("_in")).drop("_b", "_t", "_n", "_in", "_over")


def row_number_within(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 1 by ``order``, whose columns tell the group's rows apart.

    Equal to ``row_number`` over the group, but rows are ranged by group and order and numbered range by
    range, so a group with most of the rows is spread over many tasks. The ranges are written, so
    numbering reads what was ranged.
    """
    from pagewright.plans.materialize import materialize

    ranged = materialize(df.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_over"))
    inside = Window.partitionBy(group, "_p").orderBy(*order)
    numbered = ranged.withColumn("_in", F.row_number().over(inside)).join(offsets, [group, "_p"])
    return numbered.withColumn(out, (F.col("_over") + F.col("_in")).cast("long")).drop("_p", "_in", "_over")


def row_number_by_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Number rows from 1 by a distinct text column, each task sorting one range of it.

    The ranges' borders come from one sorted, written copy, so numbering reads what was ranged.
    """
    from pagewright.plans.materialize import materialize

    ranged = df.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    totals = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_over"))
    inside = Window.partitionBy("_p").orderBy(column)
    numbered = ranged.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(out, (F.col("_over") + F.col("_in")).cast("long")).drop("_p", "_in", "_over")

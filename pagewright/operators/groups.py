"""Pairs within groups and groups from pairs, without one task for a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.skew import join_weighted
from pagewright.plans.materialize import discard, materialize

#: Members of a group that are paired in one piece.
BLOCK = 128


def paired(members: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """All pairs ``a < b`` of distinct items that share a group, one row for each group they share.

    ``members`` has distinct ``(group, item)`` rows and should be a written table. A group of m items is
    spread over m / ``block`` salts by a hash of the item, and every pair of salts is a join key of its
    own: no task sorts or gathers a hot group, and none gets more than about ``block`` squared pairs of a
    key. Groups' sizes are partial aggregates; those of hot groups are broadcast to their members.
    """
    sizes = materialize(members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "group-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    salted = join_weighted(members.select(group, item), sizes, group, "_n", total)
    salted = salted.withColumn("_salts", F.ceil(F.col("_n") / block).cast("int"))
    salted = salted.withColumn("_at", F.pmod(F.xxhash64(item), F.col("_salts")).cast("int"))
    left = salted.select(group, F.col(item).alias("x"), F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_salts") - 1)).alias("_j"))
    right = salted.select(group, F.col(item).alias("y"), F.explode(F.sequence(F.lit(0), "_at")).alias("_i"), F.col("_at").alias("_j"))
    met = left.join(right, [group, "_i", "_j"]).filter("_i < _j OR x < y")
    return met.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``a, b`` edges: ``item, component``, the least item of each.

    Alternates large-star and small-star steps, which end after about log2(n) rounds; each round is
    written, so its plan stays short and a lost executor costs one round. Raises if ``rounds`` do not do.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, current = current, materialize(small.select("e.u", "e.v").filter("u != v").distinct(), "edges")
        discard(before)
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            roots = current.select(F.col("v").alias("u"), "v").distinct()
            return current.union(roots).select(F.col("u").alias("item"), F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")

"""Filling containers of fixed capacity with whole texts: minimum bin slack by subset sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.materialize import materialize

#: Items that one task packs together; the last container of each such shard is all that is lost.
SHARD = 40_000


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room`` from below.

    ``lengths`` are the lengths on hand in descending order. Sums that can be reached are the bits of one
    number; each step adds a power of two copies of one length. The search ends when ``room`` is met.
    """
    goal, limit = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            grown = (reach | reach << (length * take)) & limit
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            copies *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of lengths and how many containers have each, using all of ``counts``.

    Each pattern starts from the longest length left and fills the rest as closely as can be; it is used
    for as many containers as the counts allow.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        pattern = best_fill(left, lengths, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
        out.append((pattern, times))
        lengths = [k for k in lengths if left[k]]
    return out


def _pack_shard(capacity: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        items = shard.sort_values(["tokens", "key", "piece"], kind="stable").reset_index(drop=True)
        tokens = items["tokens"].to_numpy()
        lengths, first, times = np.unique(tokens, return_index=True, return_counts=True)
        following = dict(zip(lengths.tolist(), first.tolist(), strict=True))
        container = np.empty(len(items), dtype=np.int64)
        number = int(items["shard"].iloc[0]) << 32 if len(items) else 0
        for pattern, repeated in pack_lengths(dict(zip(lengths.tolist(), times.tolist(), strict=True)), capacity):
            for _ in range(repeated):
                for length, n in pattern.items():
                    container[following[length] : following[length] + n] = number
                    following[length] += n
                number += 1
        return items[["key", "piece", "tokens"]].assign(container=container)

    return run


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = 2048) -> DataFrame:
    """Put items into containers: ``key, piece, pieces, tokens, container``.

    An item larger than the capacity alone is split, into full containers and a rest that is packed like
    any other item; every other item is whole in one container. Items of size 0 (or a null size) have one
    row without a container. Repeated rows count once; of several sizes of one key the greatest stays;
    rows with a null key are left out. Items are packed in shards by a hash of their key, of a bounded
    number of items each, so the work is linear in their number.
    """
    once = sizes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.coalesce(F.max(size), F.lit(0)).cast("int").alias("size"))
    once = materialize(once, "sizes")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity).cast("int"))
    cut = once.withColumn("pieces", pieces).select("key", "size", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    cut = cut.withColumn("tokens", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int"))
    shards = max(1, round(once.count() / SHARD))
    placed = cut.filter("tokens > 0").withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)))
    kind = once.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, tokens int, container long"
    packed = placed.select("key", "piece", "tokens", "shard").groupBy("shard").applyInPandas(_pack_shard(capacity), schema)
    empty = cut.filter("tokens = 0").select("key", "piece", "tokens", F.lit(None).cast("long").alias("container"))
    with_pieces = packed.unionByName(empty).join(once.select("key", pieces.alias("pieces")), "key")
    return with_pieces.select(F.col("key").alias(key), "piece", "pieces", "tokens", "container")

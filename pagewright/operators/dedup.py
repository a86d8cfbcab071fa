"""Removing duplicate pages: by address, by exact content, by fingerprint in a sliding window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import hashing, text
from pagewright.operators.groups import paired
from pagewright.params import COMPAT, Params
from pagewright.plans.materialize import discard, materialize


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """The row with the least docid of each key, found by a partial aggregate over ids only."""
    least = df.groupBy(*keys).agg(F.min("docid").alias("docid")).select("docid")
    return df.join(least, "docid", "left_semi")


def by_url(pages: DataFrame, params: Params = COMPAT) -> DataFrame:
    """The first page of each address; ``compat`` tells addresses apart by their fragment too."""
    keyed = pages.withColumn("_key", F.col("url") if params.compat else text.defrag(F.col("url")))
    return _first(keyed, "_key").drop("_key")


def by_content(pages: DataFrame) -> DataFrame:
    """The first page of each exact content, by CRC-32 and length; ``crc, n_bytes`` are used where they are there."""
    if "crc" in pages.columns:
        return _first(pages, "crc", "n_bytes")
    return _first(pages.withColumns(exact_keys(pages)), "_crc", "_size").drop("_crc", "_size")


def exact_keys(pages: DataFrame, crc: str = "_crc", size: str = "_size") -> dict[str, Column]:
    return dict(zip((crc, size), hashing.exact_hash(F.col("content")), strict=True))


def similar_fingerprints(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of different fingerprints at most ``distance`` bits apart: ``fp_a, fp_b, bits``.

    Fingerprints that few bits part agree in at least one of ``distance + 1`` bands, so each band is an
    equality join; pages are the membership of a fingerprint and need no pairs of their own.
    """
    distinct = fingerprints.select("fp").distinct()
    count, width = distance + 1, 32 // (distance + 1)
    band = lambda k: F.lit(k << 33).bitwiseOR(F.shiftright("fp", k * width).bitwiseAND(F.lit((1 << width) - 1)))
    banded = distinct.select("fp", F.explode(F.array(*[band(k) for k in range(count)])).alias("band"))
    pairs = paired(materialize(banded, "bands"), "band", "fp").select("a", "b").distinct()
    bits = hashing.hamming(F.col("a"), F.col("b"))
    return pairs.withColumn("bits", bits).filter(F.col("bits") <= distance).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"), "bits")


#: Rows of a range that one task decides; ranges are at least so many windows long.
RANGE_ROWS, RANGE_WINDOWS = 1_000_000, 5


def _decide(params: Params):
    """Decide one range of pages in docid order, given the last fingerprints kept before it."""

    def run(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"r": [], "docid": [], "window": []})
        ring, filled, at = np.zeros(params.window, dtype=np.uint64), 0, 0
        if len(start):
            before = np.asarray(start["start"].iloc[0], dtype=np.int64).astype(np.uint64)
            filled = len(before)
            ring[:filled] = before
            at = filled % params.window
        rows = rows.sort_values("docid", kind="stable")
        kept = []
        for docid, fp in zip(rows["docid"].tolist(), rows["fp"].to_numpy().astype(np.uint64), strict=True):
            if (np.bitwise_count(ring[:filled] ^ fp) <= params.hamming).any():
                continue
            ring[at] = fp
            at, filled = (at + 1) % params.window, min(filled + 1, params.window)
            kept.append(docid)
        order = np.concatenate([ring[at:], ring[:at]]) if filled == params.window else ring[:filled]
        r = int(rows["r"].iloc[0])
        return pd.DataFrame({"r": r, "docid": [*kept, None], "window": [None] * len(kept) + [order.astype(np.int64).tolist()]}).astype({"docid": "Int64"})

    return run


def by_fingerprint(fingerprints: DataFrame, params: Params = COMPAT, ranges: int | None = None) -> DataFrame:
    """Docids kept when pages pass in docid order and one is dropped if its fingerprint is near to one of
    the last ``window`` kept.

    Whether a page is kept depends on the decisions before it, but only through the window. Ranges of
    docids are decided side by side, first from empty windows; then each range whose true starting
    window, the end of the range before it, differs from the one it was decided with is decided again,
    until none differs. That is the sequential result, after few rounds as windows forget their past.
    """
    rows = materialize(fingerprints.select("docid", "fp"), "fingerprints")
    if ranges is None:
        n = rows.count()
        ranges = max(1, min(n // (RANGE_WINDOWS * params.window), max(2 * rows.sparkSession.sparkContext.defaultParallelism, n // RANGE_ROWS)))
    placed = materialize(rows.repartitionByRange(ranges, "docid").withColumn("r", F.spark_partition_id()), "fingerprint-ranges")
    discard(rows)
    schema = "r int, docid long, window array<long>"
    nothing = F.array().cast("array<long>")
    used = placed.select("r").distinct().withColumn("start", nothing)
    todo, state = used, None
    while True:
        again = placed if state is None else placed.join(F.broadcast(todo.select("r")), "r", "left_semi")
        done = again.groupBy("r").cogroup(todo.groupBy("r")).applyInPandas(_decide(params), schema)
        before, state = state, materialize(done if state is None else state.join(F.broadcast(todo.select("r")), "r", "left_anti").unionByName(done), "kept-pages")
        if before is not None:
            discard(before)
        ends = state.filter("docid IS NULL").select("r", "window")
        wanted = ends.select("r", F.coalesce(F.lag("window").over(Window.orderBy("r")), nothing).alias("start"))
        joined = materialize(wanted.join(used.withColumnRenamed("start", "was"), "r"), "windows")
        used, todo = joined.select("r", "start"), joined.filter("start != was").select("r", "start")
        if todo.isEmpty():
            return state.filter("docid IS NOT NULL").select("docid")

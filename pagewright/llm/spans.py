"""Long spans that stand word for word in several documents, found with an FM-index per shard.

Documents are cut into regions around sampled seeds: every run of ``span`` characters has exactly one
seed, the least hash of its shorter runs, so documents that share a run also share its seed and put the
run into a region of that seed. Regions of seeds that only one text has are dropped. A region that several
texts have stands once, its owners apart from it; the different ones go to shards by seed. Each shard's
regions are indexed once and streamed through the index; only a seed with more of them than a block holds
is cut into blocks, every two of which are a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.batches import pieces
from pagewright.llm.fmindex import FMIndex
from pagewright.llm.neardup import BROADCAST_ROWS
from pagewright.operators.groups import components, paired
from pagewright.operators.skew import HOT, join_weighted
from pagewright.plans.materialize import discard, materialize

#: Regions in a block of a shard; a shard's cell indexes at most two blocks.
BLOCK = 4096
#: Runs of one seed are cut after so many places, which loses none of them.
_LONGEST = 512
_SHORT = 64


def _least_hashes(text: str, span: int) -> np.ndarray:
    """For each run of ``span`` characters, the least hash of the runs of ``_SHORT`` (or span / 3) in it."""
    short = min(_SHORT, max(1, span // 3))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < short:
        step = min(width, short - width)
        h = h[:-step] * np.uint64(0x5851F42D4C957F2D) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        width += step
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    places = span - short + 1
    width = 1
    while width * 2 <= places:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = places - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _seeded(texts: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                cls = np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64)
                rows.append((key, cls, len(text), np.unique(_least_hashes(text, span)).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "cls", "n", "seeds"])

    return texts.mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, cls long, n int, seeds array<long>")


def _regions(texts: DataFrame, wanted: DataFrame, few: bool, span: int) -> DataFrame:
    """``rid, seed, cls, start, region``: the stretches of one text of each class whose runs have a shared seed; ``rid`` is the region's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = []
            for cls, seeds, text in zip(batch["cls"], batch["seeds"], batch["text"], strict=True):
                least = _least_hashes(text, span).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                keep = np.isin(least[cuts[:-1]], seeds)
                for a, b in zip(cuts[:-1][keep], cuts[1:][keep], strict=True):
                    for k in range(a, b, _LONGEST):
                        region = text[k : min(k + _LONGEST, b) + span - 1]
                        rid = np.uint64(xxhash.xxh3_64_intdigest(region.encode("utf-8", "surrogatepass"))).astype(np.int64)
                        rows.append((rid, least[a], cls, k, region))
            yield pd.DataFrame(rows, columns=["rid", "seed", "cls", "start", "region"])

    joined = texts.join(F.broadcast(wanted) if few else wanted, "key")
    return joined.mapInPandas(run, "rid long, seed long, cls long, start int, region string")


def _search(span: int):
    """The search of one shard: rows of kind 0 are stretches of a region, rows of kind 1 members of a set of regions.

    A place counts if the regions in its interval belong to more than one text: ``only`` is a region's one
    text, or null where several texts have it.
    """

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        held = cell.drop_duplicates("rid").sort_values("rid")
        texts, rids = held["region"].tolist(), held["rid"].to_numpy(dtype=np.int64)
        several = held["only"].isna().to_numpy()
        only = np.where(several, rids, held["only"].fillna(0).to_numpy(dtype=np.int64))
        which, offset, interval = FMIndex(texts, span).matching_statistics(texts)
        hit = pd.DataFrame({"region": which, "at": offset, "set": interval})
        kinds = hit[["set", "region"]].drop_duplicates()
        owner = pd.Series(only[kinds["region"]], index=kinds.index)
        by_set = owner.groupby(kinds["set"])
        shared = (by_set.transform("min") != by_set.transform("max")) | pd.Series(several[kinds["region"]], index=kinds.index).groupby(kinds["set"]).transform("any")
        kinds = kinds[shared]
        if kinds.empty:
            return pd.DataFrame({"kind": [], "rid": [], "a": [], "b": [], "grp": []})
        mixed = rids[kinds["region"]].astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        name = pd.Series(mixed, index=kinds.index).groupby(kinds["set"]).sum().astype(np.uint64).astype(np.int64)
        one = name.drop_duplicates().index
        sets = kinds[kinds["set"].isin(one)]
        members = pd.DataFrame({"kind": 1, "rid": rids[sets["region"]], "a": 0, "b": 0, "grp": sets["set"].map(name)})
        covered = hit[hit["set"].isin(name.index)].sort_values(["region", "at"], kind="stable")
        new = (covered["region"].diff() != 0) | (covered["at"].diff() > 1)
        runs = covered.groupby(new.cumsum()).agg(region=("region", "first"), a=("at", "min"), b=("at", "max"))
        runs = pd.DataFrame({"kind": 0, "rid": rids[runs["region"]], "a": runs["a"], "b": runs["b"] + span, "grp": 0})
        return pd.concat([members, runs])

    return run


def _owned(owners: DataFrame, rows: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    """``rows`` of regions with the texts that own them. Of a region with a large part of all owners, the rows,
    at most so many as it has places, are broadcast."""
    hot = weights.filter(F.col("n") * HOT >= total).filter(F.col("n") > HOT).select("rid")
    if hot.isEmpty():
        return owners.join(rows, "rid")
    some = F.broadcast(hot)
    heavy = owners.join(F.broadcast(rows.join(some, "rid", "left_semi")), "rid")
    return heavy.unionByName(owners.join(some, "rid", "left_anti").join(rows, "rid"))


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find all runs of ``span`` or more characters that several different texts have.

    Returns ``members`` (``key, cls, n``: each row's class of equal texts and length), ``intervals``
    (``cls, a, b``: stretches of a text that other texts have, which may overlap) and ``sets``
    (``grp, cls``: texts that have a run in common). Rows with a null key or text, or a text shorter
    than ``span``, are left out; repeated rows count once; texts are read whole.
    """
    rows = documents.filter(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    seeded = materialize(_seeded(rows, span), "seeded")
    members = materialize(seeded.select(F.col("key").alias(key), "cls", "n").distinct(), "members")
    reps = seeded.groupBy("cls").agg(F.min("key").alias("key"))
    seeds = seeded.select(F.explode("seeds").alias("seed"), "cls").dropDuplicates(["seed", "cls"])
    several = materialize(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several-seeds")
    figures = several.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    count = figures["total"] or 0
    hot = (figures["most"] or 0) > HOT and figures["most"] * HOT >= count
    shared = join_weighted(seeds, several, "seed", "n", count) if hot else seeds.join(several, "seed")
    wanted = materialize(shared.groupBy("cls").agg(F.collect_list("seed").alias("seeds")).join(reps, "cls"), "wanted")
    regions = materialize(_regions(rows, wanted, count <= BROADCAST_ROWS, span).dropDuplicates(["cls", "start", "seed"]), "regions")
    discard(several, wanted, seeded)
    owners = regions.select("rid", "cls", "start", F.length("region").alias("length"))
    kinds = regions.groupBy("rid").agg(F.first("region").alias("region"), F.min("seed").alias("seed"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("n"))
    kinds = materialize(kinds, "different-regions")
    weights, total = kinds.select("rid", "n"), owners.count()
    buckets = max(1, -(-kinds.count() * 4 // (3 * BLOCK)))
    placed = kinds.select("rid", "region", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"), F.pmod(F.xxhash64("seed"), F.lit(buckets)).alias("bucket"))
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, "bucket").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("blk", k).alias("i"), F.greatest("blk", k).alias("j")))
    spread = placed.select("bucket", "rid", "region", "only", "blocks", F.explode(cells).alias("c"))
    spread = spread.filter("c.i < c.j OR blocks = 1").select("bucket", "rid", "region", "only", "c.i", "c.j")
    found = spread.groupBy("bucket", "i", "j").applyInPandas(_search(span), "kind int, rid long, a int, b int, grp long")
    found = materialize(found, "spans")
    alike = kinds.filter("low != high")
    whole = alike.select("rid", F.lit(0).alias("a"), F.length("region").alias("b"))
    stretches = found.filter("kind = 0").select("rid", "a", "b").unionByName(whole)
    intervals = _owned(owners, stretches, weights, total).select("cls", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    named = found.filter("kind = 1").select("grp", "rid").unionByName(alike.select(F.col("rid").alias("grp"), "rid"))
    sets = materialize(_owned(owners.select("rid", "cls"), named.distinct(), weights, total).select("grp", "cls").distinct(), "span-sets")
    return members, intervals, sets


def sharing_pairs(members: DataFrame, sets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every pair of keys that have a run in common, smaller first, equal texts included."""
    copies = paired(members.select("cls", key), "cls", key).select("a", "b")
    links = materialize(paired(sets, "grp", "cls").select("a", "b").distinct(), "span-links")
    left, right = (members.select(F.col("cls").alias(c), F.col(key).alias(f"k{c}")) for c in "ab")
    across = links.join(left, "a").join(right, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return copies.union(across).distinct().select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def shared_shares(members: DataFrame, intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_chars, shared_chars, share``: how much of each text stands elsewhere; all of it where another row has the same text."""
    ordered = Window.partitionBy("cls").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("b").over(ordered), F.lit(0))
    stretches = intervals.distinct().withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", reached)))
    covered = stretches.groupBy("cls").agg(F.sum("new").alias("covered"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    joined = members.join(copies, "cls").join(covered, "cls", "left")
    chars = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return joined.select(key, F.col("n").cast("long").alias("n_chars"), chars.alias("shared_chars"), F.round(chars / F.col("n"), 6).alias("share"))


def sharing_groups(members: DataFrame, sets: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a key: ``key, cls, links, grp``; ``links`` counts other texts that have a run in common with it,
    ``grp`` names the connected group. Groups come from each set's links to its least member only."""
    pairs = materialize(paired(sets, "grp", "cls").select("a", "b").distinct(), "span-links")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    counted = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    least = sets.groupBy("grp").agg(F.min("cls").alias("a"))
    joined = components(sets.join(least, "grp").select("a", F.col("cls").alias("b"))).withColumnsRenamed({"item": "cls", "component": "grp"})
    out = members.select(key, "cls").join(counted, "cls", "left").join(joined, "cls", "left")
    return out.select(key, "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("grp", "cls").alias("grp"))

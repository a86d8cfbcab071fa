"""Near-duplicate pages: a MinHash LSH forest for candidates, then exact verification.

Each text has a label in every tree of the forest: its MinHash symbols, as many as a trie is deep. Texts
with a common prefix stand under one node. Prefixes start at the depth at which all trees together reach
the recall at the threshold. There, most nodes hold one text or a few; those are settled. Under a dense
node (a site's template) a text goes down to the first node that is small enough, which costs it some
recall; how small a text's nodes must be is relaxed, its matched prefixes shortened again, until its trees
reach the recall together. So texts in sparse parts are compared at the base depth, those in dense ones as
deep as the recall allows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.batches import pieces
from pagewright.llm.markup import visible_text
from pagewright.operators.groups import BLOCK, components, paired
from pagewright.operators.skew import HOT, join_weighted, partitions_for
from pagewright.plans.materialize import discard, materialize

WORD = re.compile(r"\w+")
#: Rows of an id table that may be broadcast (16 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Bits of a text's sketch.
SKETCH = 512
#: Texts under a node that is not dense; how often that bound is made four times as large before it falls.
FEW, BOUNDS = 4, 8


class WordHashes(dict):
    """64-bit hashes of words, remembered between calls."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[str], width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    h = known.of(words)
    n = len(h) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_depth(threshold: float, trees: int, recall: float, deepest: int) -> int:
    """The deepest level at which pairs at the threshold meet with the recall if all trees stop there."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach a recall of {recall} at {threshold}")


class Forest:
    """Hash functions of ``trees`` prefix tries, ``deepest`` symbols deep; a label is 64 bits at most.

    The first ``SKETCH`` functions also give one bit each to a text's sketch. A function multiplies the
    shingles' mixed hashes by an odd number, modulo 2 ** 32.
    """

    def __init__(self, trees: int, deepest: int, seed: int = 20240229):
        self.trees, self.deepest, self.width = trees, deepest, 64 // deepest
        self.count = max(trees * deepest, SKETCH)
        self.a = np.random.default_rng(seed).integers(0, 1 << 32, self.count, dtype=np.uint32) | np.uint32(1)
        self.room: np.ndarray | None = None

    def minima(self, shingled: np.ndarray) -> np.ndarray:
        """The least hash of each function; the table of some shingles at a time stays in the cache."""
        x = ((shingled ^ (shingled >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.count, np.uint32(0xFFFFFFFF))
        if self.room is None:
            self.room = np.empty((128, self.count), dtype=np.uint32)
        for k in range(0, len(x), 128):
            some = x[k : k + 128, None]
            room = self.room[: len(some)]
            np.multiply(some, self.a, out=room)
            np.minimum(least, room.min(axis=0), out=least)
        return least

    def place(self, shingled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's label in each tree, the first symbol in front, and its sketch, both as signed 64-bit numbers."""
        least = self.minima(shingled)
        mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(13)
        symbols = (mixed[: self.trees * self.deepest] & np.uint32((1 << self.width) - 1)).astype(np.uint64).reshape(self.trees, self.deepest)
        labels = np.zeros(self.trees, dtype=np.uint64)
        for k in range(self.deepest):
            labels |= symbols[:, k] << np.uint64(64 - self.width * (k + 1))
        bits = np.packbits((mixed[:SKETCH] >> np.uint32(31)).astype(np.uint8)).view(np.int64)
        return labels.astype(np.int64), bits


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def signatures(pages: DataFrame, key: str, content: str, width: int, forest: Forest, html: bool) -> DataFrame:
    """``key, cls, at, labels, bits`` of each row with at least ``width`` words; ``cls`` is the text's hash.

    Only the first row of a text in a task carries labels and a sketch, so an often copied text is placed
    once a task; ``at`` tells the rows apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        placed: set[int] = set()
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 40
        for batch in pieces(batches):
            rows = []
            for k, text in zip(batch["key"], batch["content"], strict=True):
                words = WORD.findall((visible_text(text) if html else text).lower())
                if len(words) < width:
                    continue
                cls = _signed(xxhash.xxh3_64_intdigest(" ".join(words)))
                labels, bits = (None, None) if cls in placed else forest.place(shingles(words, width, known))
                placed.add(cls)
                rows.append((k, cls, at, labels, bits))
                at += 1
            yield pd.DataFrame(rows, columns=["key", "cls", "at", "labels", "bits"])

    kind = pages.schema[key].dataType.simpleString()
    chosen = pages.filter(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    return chosen.mapInPandas(run, f"key {kind}, cls long, at long, labels array<long>, bits array<long>")


def _once(signed: DataFrame) -> DataFrame:
    """One placed row of each text; the texts that several tasks placed are found by their numbers only."""
    placed = signed.filter("labels IS NOT NULL")
    several = materialize(placed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).filter("n > 1").select("cls", "first"), "placed-again")
    n = several.count()
    if not n:
        return placed
    joined = placed.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "cls", "left")
    return joined.filter("first IS NULL OR at = first").drop("first")


def _hot_nodes(rows: DataFrame, total: int) -> DataFrame | None:
    """Nodes with at least ``total / HOT`` rows, of which there can be no more than ``HOT``; None if there are none.

    Rows are counted by a part of their node's name first, so only few numbers are moved; nodes are counted
    by themselves under names that are that frequent only.
    """
    least = max(total // HOT, HOT)
    part = F.pmod("node", F.lit(1 << 16))
    crowded = materialize(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "crowded")
    if crowded.isEmpty():
        return None
    named = rows.withColumn("part", part).join(F.broadcast(crowded.select("part")), "part", "left_semi")
    hot = materialize(named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "hot-nodes")
    return None if hot.isEmpty() else hot


def _pairs_of_few(rows: DataFrame) -> DataFrame:
    """All pairs under nodes of a bounded number of texts."""
    held = rows.groupBy("node").agg(F.collect_list("at").alias("held"))
    one = held.select("held", F.posexplode("held").alias("i", "x"))
    other = one.select("x", F.explode(F.expr("slice(held, i + 2, size(held))")).alias("y"))
    return other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs_met(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Each query text with all members of its node. Large nodes are salted on both sides, so a key has about BLOCK squared pairs at most."""
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    left = queries.select("node", F.col("at").alias("x"), F.pmod(F.xxhash64("at"), salts).alias("i"), every.alias("j"))
    right = members.select("node", F.col("at").alias("y"), every.alias("i"), F.pmod(F.xxhash64("at"), salts).alias("j"))
    met = left.join(right, ["node", "i", "j"]).filter("x != y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _below(depth: int, base: int, forest: Forest) -> Column:
    """The name of the node at a depth below a text's base node."""
    if depth == base:
        return F.col("node")
    return F.xxhash64("node", F.lit(depth), F.shiftrightunsigned("rest", forest.width * (forest.deepest - depth)))


def _ways(dense: DataFrame, base: int, forest: Forest) -> DataFrame:
    """``at, node, way``: the nodes from the base to the full depth that a text leads through, each with its depth and size."""
    depths = range(base, forest.deepest + 1)
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), _below(d, base, forest).alias("node")) for d in depths])
    cold = dense.filter("NOT hot").repartition("node").withColumn("levels", levels)
    for k, d in enumerate(depths):
        cold = cold.withColumn(f"n{d}", F.count(F.lit(1)).over(Window.partitionBy("node", F.get("levels", F.lit(k))["node"])))
    sized = F.array(*[F.struct(F.lit(d).alias("depth"), F.get("levels", F.lit(k))["node"].alias("node"), F.col(f"n{d}").alias("n")) for k, d in enumerate(depths)])
    cold = cold.select("at", "node", sized.alias("way"))
    hot = dense.filter("hot")
    held = hot.count()
    if not held:
        return cold
    lower = materialize(hot.select("at", "node", F.explode(levels).alias("l")).select("at", F.col("node").alias("top"), "l.depth", "l.node"), "lower-nodes")
    sizes = materialize(lower.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "lower-sizes")
    met = join_weighted(lower, sizes, "node", "n", held * len(depths))
    whole = met.groupBy("at", F.col("top").alias("node")).agg(F.sort_array(F.collect_list(F.struct("depth", F.col("node").alias("node"), "n"))).alias("way"))
    return cold.unionByName(whole)


def forest_candidates(labels: DataFrame, forest: Forest, threshold: float, recall: float, few: int = FEW) -> DataFrame:
    """Pairs ``a, b`` of numbers that share a node, out of ``at, labels`` (a text's number, its label in each tree).

    All pairs of nodes of at most ``few`` texts at the base depth are given. In trees where its node there
    is larger, a text goes down until its node has at most ``few`` texts, or until as many of the node's
    other texts as the threshold says would go the same way down: those are near-duplicates, not a
    template's pages, and going on would part them. Nodes at the full depth are always compared. A text's
    recall is that of a pair at the threshold over its trees, 1 - product of (1 - t ** depth); where it is
    too low, the bound on its nodes is made 4, 16, 64 ... times as large until it is reached, and without
    any bound, at the base depth, it always is. Rows are moved by their base node once, but for those of
    hot nodes, which are counted before they are moved.
    """
    base = prefix_depth(threshold, forest.trees, recall, forest.deepest)
    gain = [-math.log(1 - threshold**d) for d in range(base, forest.deepest + 1)]
    need = -math.log(1 - recall)
    total = labels.count() * forest.trees
    cut, used = forest.width * base, forest.width * forest.deepest
    rows = labels.select("at", F.posexplode("labels").alias("tree", "label"))
    top = F.xxhash64("tree", F.shiftrightunsigned("label", 64 - cut))
    rest = F.shiftrightunsigned("label", 64 - used).bitwiseAND(F.lit((1 << (used - cut)) - 1))
    rows = rows.select(top.alias("node"), "at", rest.alias("rest"))
    hot = _hot_nodes(rows, total)
    cold = rows if hot is None else rows.join(F.broadcast(hot.select("node")), "node", "left_anti")
    parted = cold.repartition(partitions_for(labels.sparkSession, total), "node")
    sizes = parted.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = parted.join(sizes.hint("shuffle_hash"), "node").withColumn("hot", F.lit(False))
    if hot is not None:
        shared = shared.unionByName(rows.join(F.broadcast(hot), "node").withColumn("hot", F.lit(True)))
    shared = materialize(shared, "shared-nodes")
    sparse = _pairs_of_few(shared.filter(F.col("n") <= few))
    dense = shared.filter(F.col("n") > few)
    if dense.isEmpty():
        out = materialize(sparse.distinct(), "candidates")
        discard(shared)
        return out
    alike = f"way[i + 1].n - 1 >= {threshold} * (x.n - 1)"
    stop = lambda most: f"element_at(filter(way, (x, i) -> x.n <= {most} OR i + 1 = size(way) OR {alike}), 1)"
    stops = F.expr(f"array({', '.join([*[stop(few * 4**k) for k in range(BOUNDS)], 'way[0]'])})")
    ways = materialize(_ways(dense, base, forest).select("at", "way", stops.alias("stops")), "ways")
    gained = F.array(*[F.lit(g) for g in gain])
    reached = [F.sum(F.element_at(gained, F.get("stops", F.lit(k))["depth"] - (base - 1))).alias(f"g{k}") for k in range(BOUNDS)]
    missing = F.lit(need) - (F.lit(forest.trees) - F.col("trees")) * gain[0]
    bound = F.coalesce(*[F.when(F.col(f"g{k}") >= missing, F.lit(k)) for k in range(BOUNDS)], F.lit(BOUNDS)).alias("bound")
    allowed = ways.groupBy("at").agg(F.count(F.lit(1)).alias("trees"), *reached).select("at", bound)
    queries = ways.join(allowed, "at").select("at", F.get("stops", F.col("bound")).alias("f")).select("at", "f.node", "f.n").filter("n > 1")
    queries = materialize(queries, "forest-queries")
    members = ways.select("at", F.explode("way").alias("w")).select("at", "w.node", "w.n").filter("n > 1")
    crowded = _pairs_met(queries, members.join(queries.select("node").distinct(), "node", "left_semi"))
    out = materialize(sparse.union(crowded).distinct(), "candidates")
    discard(shared, ways, queries)
    return out


def likely_pairs(candidates: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Classes ``a, b`` of the candidates whose sketches do not put them far (five standard errors) below the threshold.

    ``sketches`` has ``at, cls, bits``. A bit of two sketches is equal with a probability of (1 + similarity) / 2.
    """
    equal = (1 + threshold) / 2
    most = SKETCH - math.ceil(SKETCH * (equal - 5 * math.sqrt(equal * (1 - equal) / SKETCH)))
    left, right = (sketches.select(F.col("at").alias(c), F.col("cls").alias(f"c{c}"), F.col("bits").alias(f"s{c}")) for c in "ab")
    apart = [F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k)))).cast("int") for k in range(SKETCH // 64)]
    met = candidates.join(left, "a").join(right, "b").filter(sum(apart[1:], apart[0]) <= most)
    return met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def _verify(pairs: DataFrame, reps: DataFrame, pages: DataFrame, key: str, content: str, width: int, threshold: float, html: bool) -> DataFrame:
    """Those of ``a, b`` whose exact similarity reaches the threshold, with ``similarity``."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(reps, "cls")
    wanted = materialize(wanted, "wanted")
    ids = wanted.select("cls", F.col("rep").alias("key"))
    small = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    texts = pages.filter(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content")).join(small, "key")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in pieces(batches):
            rows = []
            for cls, text in zip(batch["cls"], batch["content"], strict=True):
                words = WORD.findall((visible_text(text) if html else text).lower())
                if _signed(xxhash.xxh3_64_intdigest(" ".join(words))) == cls:
                    rows.append((cls, shingles(words, width, known).tobytes()))
            yield pd.DataFrame(rows, columns=["cls", "found"])

    sets = materialize(texts.mapInPandas(read, "cls long, found binary").dropDuplicates(["cls"]), "shingle-sets")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = []
            for x, y in zip(batch["fa"], batch["fb"], strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(common / (len(p) + len(q) - common))
            yield batch[["a", "b"]].assign(similarity=out)

    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("found").alias("fb")), "b")
    return joined.mapInPandas(compare, "a long, b long, similarity double").filter(F.col("similarity") >= threshold)


def near_duplicates(
    pages: DataFrame,
    key: str = "docid",
    content: str = "content",
    width: int = 5,
    threshold: float = 0.8,
    trees: int = 128,
    recall: float = 0.998,
    deepest: int = 7,
    html: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Texts whose distinct ``width``-word runs have a Jaccard similarity of ``threshold`` or more.

    Returns ``(members, links)``: ``key, cls`` of every row, rows of equal words sharing a class, and
    ``a, b, similarity`` of classes of different texts, a < b. Candidates come from the forest
    (:func:`forest_candidates`); sketches discard those far below the threshold, the rest are compared
    exactly. Rows with a null key, null content or fewer than ``width`` words are in no class. Repeated
    rows count once. Texts are read whole.
    """
    forest = Forest(trees, deepest)
    signed = materialize(signatures(pages, key, content, width, forest, html), "signatures")
    members = materialize(signed.select(F.col("key").alias(key), "cls").distinct(), "members")
    reps = materialize(signed.groupBy("cls").agg(F.min("key").alias("rep")), "representatives")
    once = _once(signed)
    candidates = forest_candidates(once.select("at", "labels"), forest, threshold, recall)
    likely = materialize(likely_pairs(candidates, once.select("at", "cls", "bits"), threshold), "likely")
    discard(signed, candidates)
    links = materialize(_verify(likely, reps, pages, key, content, width, threshold, html), "links")
    discard(likely, reps)
    return members, links


def all_pairs(members: DataFrame, links: DataFrame, key: str = "docid") -> DataFrame:
    """Every pair of different keys, smaller first: within a class, and across linked classes."""
    copies = paired(members.select("cls", key), "cls", key).select("a", "b")
    left, right = (members.select(F.col("cls").alias(c), F.col(key).alias(f"k{c}")) for c in "ab")
    across = links.select("a", "b").join(left, "a").join(right, "b").filter("ka != kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return copies.union(across).distinct().select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def duplicate_groups(members: DataFrame, links: DataFrame, key: str = "docid") -> DataFrame:
    """One row a key: ``key, cls, links, grp``; ``links`` counts other classes linked, ``grp`` names the connected group."""
    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls")))
    counted = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    joined = components(links).withColumnsRenamed({"item": "cls", "component": "grp"})
    out = members.join(counted, "cls", "left").join(joined, "cls", "left")
    return out.select(key, "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("grp", "cls").alias("grp"))

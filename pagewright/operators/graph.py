"""Link analysis: the link graph, PageRank and HITS as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.operators.skew import HOT, join_weighted, keyed_counts
from pagewright.params import COMPAT, Params
from pagewright.plans.materialize import delete_path, materialize, new_path


def link_graph(doclinks: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of links whose source and target are documents; of documents with one url
    the last is the target. Links to oneself stay. A url or a source with a large part of all links is
    counted first and its row broadcast, so its links stay where they are."""
    links = materialize(doclinks.filter("src IS NOT NULL AND dst_url IS NOT NULL").select("src", "dst_url").distinct(), "links")
    total = links.count()
    targets = docs.groupBy("url").agg(F.max("docid").alias("dst")).withColumnRenamed("url", "dst_url")
    targets = materialize(keyed_counts(links, "dst_url", "_w").join(targets, "dst_url"), "targets")
    sources = materialize(keyed_counts(links, "src", "_w").join(docs.select(F.col("docid").alias("src")), "src", "left_semi"), "sources")
    reached = materialize(join_weighted(links, targets, "dst_url", "_w", total).select("src", "dst"), "reached")
    return join_weighted(reached, sources, "src", "_w", total).select("src", "dst").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


class _Steps:
    """Writes each step's vector, measures its rows in the same job, and removes steps no longer read."""

    def __init__(self, df: DataFrame, label: str, keep: int = 2):
        self.spark, self.label, self.keep, self.paths = df.sparkSession, label, keep, []
        self.schema = df.schema

    def write(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        path = new_path(self.spark, self.label)
        rows = df.select(self.schema.names)
        seen = Observation()
        (rows.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else rows).write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            delete_path(self.spark, self.paths.pop(0))
        return self.spark.read.schema(self.schema).parquet(path), seen.get if measures else {}


class _Edges:
    """Edges written in two parts by a key of theirs: hot keys, whose values can be broadcast whatever the
    data's size, and the others, of which none has a large part of the rows."""

    def __init__(self, edges: DataFrame, key: str):
        self.key = key
        self.edges = materialize(edges, "edges")
        counts = keyed_counts(self.edges, key, "_w")
        least = self.edges.count() / HOT
        self.hot = materialize(counts.filter((F.col("_w") >= least) & (F.col("_w") > HOT)).select(key), "hot-keys")
        self.any_hot = not self.hot.isEmpty()

    def joined(self, vector: DataFrame) -> DataFrame:
        """Each edge with the values that ``vector``, one row a ``docid``, has for its key."""
        values = vector.withColumnRenamed("docid", self.key)
        if not self.any_hot:
            return self.edges.join(values, self.key)
        hot = F.broadcast(self.hot)
        heavy = self.edges.join(F.broadcast(values.join(hot, self.key, "left_semi")), self.key)
        return heavy.unionByName(self.edges.join(hot, self.key, "left_anti").join(values, self.key))


def pagerank(edges: DataFrame, nodes: DataFrame, params: Params = COMPAT) -> DataFrame:
    """``docid, pr`` of all nodes: teleport 1 - d, start 1 / n, no redistribution from dead ends.

    Each step is one job: a join of ranks with the prepared edges and one aggregate that combines before
    its shuffle, so a target with a third of all links costs one row a task. The step's vector is written
    with what each rank was divided by, so plans stay short. On convergence the vector before the last
    step is returned.
    """
    nodes = materialize(nodes.select("docid").join(out_degree(edges).withColumnRenamed("src", "docid"), "docid", "left"), "nodes")
    n = nodes.count()
    graph = _Edges(edges.select("src", "dst"), "src")
    steps = _Steps(nodes.select("docid", F.lit(0.0).alias("pr"), F.lit(0.0).alias("given"), F.lit(0).cast("long").alias("degree")), "pagerank")
    give = lambda pr: F.coalesce(F.try_divide(pr, F.col("degree")), F.lit(0.0)).alias("given")
    first = F.lit(1.0 / max(n, 1))
    before, _ = steps.write(nodes.select("docid", first.alias("pr"), give(first), "degree"))
    for _ in range(params.iterations):
        given = graph.joined(before.select("docid", "given")).groupBy(F.col("dst").alias("docid")).agg(F.sum("given").alias("sum"))
        rank = F.lit(1 - params.damping) + F.lit(params.damping) * F.coalesce("sum", F.lit(0.0))
        ranked = before.withColumnRenamed("pr", "old").join(given, "docid", "left").withColumn("pr", rank)
        moved = ranked.withColumn("moved", F.abs(F.col("pr") - F.col("old"))).select("docid", "pr", give(F.col("pr")), "degree", "moved")
        after, seen = _measured(steps, moved)
        if seen is None or seen < params.tolerance:
            return before.select("docid", "pr")
        before = after
    return before.select("docid", "pr")


def _measured(steps: _Steps, df: DataFrame) -> tuple[DataFrame, float | None]:
    """Write a step without its column ``moved`` and return that column's greatest value."""
    seen = Observation()
    after, _ = steps.write(df.observe(seen, F.max("moved").alias("moved")))
    return after, seen.get["moved"]


def hits(edges: DataFrame, nodes: DataFrame, params: Params = COMPAT) -> DataFrame:
    """``docid, hub, auth`` of all nodes. Hubs add up the authorities they link to; authorities add up, in
    ``compat``, the hubs that they link to, else the hubs that link to them. Both are divided by their
    Euclidean norm. On convergence the vectors before the last step are returned.

    A step is one job that writes the sums undivided and measures their norms; the next one divides as it
    reads, and measures how far the vector it reads had moved, so convergence is seen one job later.
    """
    nodes = materialize(nodes.select("docid"), "nodes")
    out = _Edges(edges.select("src", "dst"), "dst")
    into = None if params.compat else _Edges(edges.select("src", "dst"), "src")
    zero = F.lit(0.0)
    steps = _Steps(nodes.select("docid", *[zero.alias(c) for c in ("hub", "auth", "hub0", "auth0")]), "hits", keep=3)
    one = F.lit(1.0)
    raw, _ = steps.write(nodes.select("docid", one.alias("hub"), one.alias("auth"), one.alias("hub0"), one.alias("auth0")))
    norms, vectors = (1.0, 1.0), []
    square = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    for step in range(params.iterations + 1):
        scaled = raw.select("docid", (F.col("hub") / norms[0]).alias("hub"), (F.col("auth") / norms[1]).alias("auth"), "hub0", "auth0")
        vectors = [*vectors[-1:], scaled.select("docid", "hub", "auth")]
        given = out.joined(scaled.select("docid", "hub", "auth")).groupBy(F.col("src").alias("docid"))
        if into is None:
            sums = given.agg(F.sum("auth").alias("h"), F.sum("hub").alias("a"))
        else:
            back = into.joined(scaled.select("docid", "hub")).groupBy(F.col("dst").alias("docid")).agg(F.sum("hub").alias("a"))
            sums = given.agg(F.sum("auth").alias("h")).join(back, "docid", "full")
        moved = F.greatest(F.abs(F.col("hub") - F.col("hub0")), F.abs(F.col("auth") - F.col("auth0")))
        seen = Observation()
        watched = scaled.withColumn("moved", moved).observe(seen, F.max("moved").alias("moved"))
        new = watched.select("docid", F.col("hub").alias("hub0"), F.col("auth").alias("auth0")).join(sums, "docid", "left")
        new = new.select("docid", F.coalesce("h", zero).alias("hub"), F.coalesce("a", zero).alias("auth"), "hub0", "auth0")
        after, norm = steps.write(new, h=square("hub"), a=square("auth"))
        if step and (seen.get["moved"] is None or seen.get["moved"] < params.tolerance):
            return vectors[0]
        if step < params.iterations:
            raw, norms = after, (norm["h"] or 1.0, norm["a"] or 1.0)
    return vectors[-1]


def with_quality(docinfo: DataFrame, ranks: DataFrame, scores: DataFrame) -> DataFrame:
    """A document table with fresh qualities where there are any, else the old ones."""
    joined = docinfo.join(ranks, "docid", "left").join(scores, "docid", "left")
    new = lambda old, fresh: F.coalesce(F.col(fresh).cast("float"), F.col(old)).alias(old)
    return joined.select("docid", "total_tokens", new("pr_quality", "pr"), new("hub_quality", "hub"), new("auth_quality", "auth"), "url")

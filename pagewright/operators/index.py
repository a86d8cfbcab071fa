"""The inverted index: postings, document table, link table, statistics, storage and lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import hashing, text
from pagewright.functions.html_parser import parsed
from pagewright.operators import dedup
from pagewright.params import COMPAT, IMPORTANT_TAGS, Params
from pagewright.plans.materialize import materialize, shuffles_go


def token_counts(pages: DataFrame, params: Params = COMPAT) -> DataFrame:
    """``docid, word, tf``: how often each unstemmed token stands in a page; ``compat`` glues the text of
    adjacent elements together."""
    gap = "" if params.compat else " "
    visible = parsed(F.col("content"), F.col("url"), gap)["text"] if params.parser else text.html_text(F.col("content"), gap)
    words = pages.select("docid", F.explode(text.tokens(visible)).alias("word"))
    return words.groupBy("docid", "word").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Distinct words with their stem and the lower half of their CRC-64: ``word, token, low``."""
    words = counts.select("word").distinct()
    low = hashing.crc64(F.col("word")).bitwiseAND(F.lit(0xFFFFFFFF))
    return text.stemmed(words, "word", "token").withColumn("low", low)


def fingerprints(pages: DataFrame, counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The simhash of each page, of pages without tokens too."""
    hashed = hashing.simhash(counts.join(vocab.select("word", "low"), "word"))
    return pages.select("docid").join(hashed, "docid", "left").select("docid", F.coalesce("fp", F.lit(0).cast("long")).alias("fp"))


def stemmed_counts(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``docid, token, tf`` by stem."""
    joined = counts.join(vocab.select("word", "token"), "word")
    return joined.groupBy("docid", "token").agg(F.sum("tf").cast("int").alias("tf"))


def important_ranks(pages: DataFrame, params: Params = COMPAT) -> DataFrame:
    """``docid, token, important``: the least tag rank under which a stem stands, an element's text
    belonging to the first of the tags only."""
    if params.parser:
        parts = pages.select("docid", F.explode(parsed(F.col("content"), F.col("url"), " ")["important"]).alias("p")).select("docid", "p.rank", F.col("p.text").alias("part"))
    else:
        shown = pages.select("docid", text.without_hidden(F.col("content")).alias("content"))
        found = [F.struct(F.lit(rank).cast("tinyint").alias("rank"), text.important_text(F.col("content"), tag).alias("part")) for rank, tag in enumerate(IMPORTANT_TAGS, 1)]
        parts = shown.select("docid", F.explode(F.array(*found)).alias("p")).select("docid", "p.rank", "p.part")
    rows = parts.select("docid", "rank", F.explode(text.tokens(F.col("part"))).alias("word"))
    ranked = rows.groupBy("docid", "word").agg(F.min("rank").alias("rank"))
    stems = text.stemmed(ranked.select("word").distinct(), "word", "token")
    return ranked.join(stems, "word").groupBy("docid", "token").agg(F.min("rank").alias("important"))


def page_links(pages: DataFrame, params: Params = COMPAT) -> DataFrame:
    """Distinct ``src, dst_url`` of the pages' links, resolved and without fragment."""
    if params.parser:
        return pages.select(F.col("docid").alias("src"), F.explode(parsed(F.col("content"), F.col("url"))["links"]).alias("dst_url")).distinct()
    found = pages.select("docid", "url", F.explode(text.hrefs(F.col("content"), keep_important=not params.compat)).alias("href"))
    target = text.defrag(text.resolved(F.col("url"), text.decoded(F.col("href"))))
    return found.select(F.col("docid").alias("src"), target.alias("dst_url")).distinct()


#: Tokens that may be broadcast to the postings.
FEW_WORDS = 100_000


@dataclass(frozen=True)
class Index:
    """``docinfo``: docid, total_tokens, three qualities, url. ``postings``: bid, token, docid, tf,
    important. ``doclinks``: src, dst_url."""

    docinfo: DataFrame
    postings: DataFrame
    doclinks: DataFrame


def build(pages: DataFrame, params: Params = COMPAT, write: bool = True) -> Index:
    """Index cleaned pages ``docid, url, content``: duplicates out, tokens counted, links kept.

    Address and exact copies go first, near copies by fingerprint, in the order that each sees only what
    the one before it kept. Token counts are written once (unless ``write`` is off) and feed the
    fingerprints, the postings and the document table.
    """
    keep = materialize if write else lambda df, _: df
    delivered = keep(pages.select("docid", "url", "content").withColumns(dedup.exact_keys(pages, "crc", "n_bytes")), "pages")
    ids = keep(dedup.by_content(dedup.by_url(delivered.drop("content"), params)).select("docid"), "unique-ids")
    unique = delivered.join(ids, "docid", "left_semi").select("docid", "url", "content")
    counts = keep(token_counts(unique, params), "token-counts")
    vocab = keep(vocabulary(counts), "vocabulary")
    kept = keep(dedup.by_fingerprint(fingerprints(unique, counts, vocab), params), "kept")
    kept_pages = unique.join(kept, "docid", "left_semi")
    bags = keep(stemmed_counts(counts.join(kept, "docid", "left_semi"), vocab), "bags")
    important = F.lit(0).cast("tinyint")
    if params.compat:
        postings = bags.withColumn("important", important)
    else:
        postings = bags.join(important_ranks(kept_pages, params), ["docid", "token"], "left").withColumn("important", F.coalesce("important", important))
    postings = postings.select(text.bucket(F.col("token")).alias("bid"), "token", "docid", "tf", "important")
    totals = bags.groupBy("docid").agg(F.count(F.lit(1)).cast("int").alias("total_tokens"))
    one = F.lit(1.0).cast("float")
    docinfo = kept_pages.select("docid", text.defrag(F.col("url")).alias("url")).join(totals, "docid", "left")
    docinfo = docinfo.select(
        "docid", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), one.alias("pr_quality"), one.alias("hub_quality"), one.alias("auth_quality"), "url"
    )
    return Index(docinfo, postings, page_links(kept_pages, params))


def save(index: Index, folder: str) -> None:
    """Write an index: postings in buckets, sorted by token and docid, the other tables plain.

    A bucket's rows go to as many files as its share of tokens warrants: rows are spread by bucket and a
    hash of the token, so a bucket with most of the rows is not one task. Postings are cleaned once here,
    where they have been spread, so they are moved once; their tokens' frequencies are kept beside them,
    so opening the index reads no postings.
    """
    spark = index.postings.sparkSession
    with shuffles_go(spark):
        spread_postings(index.postings).write.mode("overwrite").partitionBy("bid").parquet(f"{folder}/postings")
        written = spark.read.parquet(f"{folder}/postings")
        counted = written.groupBy("bid", "token").agg(F.count(F.lit(1)).alias("df"))
        counted.write.mode("overwrite").partitionBy("bid").parquet(f"{folder}/frequencies")
        index.docinfo.write.mode("overwrite").parquet(f"{folder}/docinfo")
        index.doclinks.write.mode("overwrite").parquet(f"{folder}/doclinks")


def spread_postings(postings: DataFrame) -> DataFrame:
    """Valid postings by bucket, token and docid, spread by bucket and a hash of the token."""
    placed = postings.withColumns({"bid": text.bucket(F.col("token")), "_part": F.pmod(F.xxhash64("token"), F.lit(16))})
    return valid_postings(placed.repartition("bid", "_part")).drop("_part").sortWithinPartitions("bid", "token", "docid")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("docinfo", "postings", "doclinks")))


def merge(old: Index, new: Index) -> Index:
    """Two indexes in one; a docid that the new one has replaces the old one's rows."""
    fresh = new.docinfo.select("docid")
    keep = lambda df, key: df.join(fresh.withColumnRenamed("docid", key), key, "left_anti")
    return Index(
        keep(old.docinfo, "docid").unionByName(new.docinfo),
        keep(old.postings, "docid").unionByName(new.postings),
        keep(old.doclinks, "src").unionByName(new.doclinks).distinct(),
    )


def valid_postings(postings: DataFrame) -> DataFrame:
    """Distinct postings with a count of at least 1."""
    return postings.filter("tf > 0 AND token IS NOT NULL AND docid IS NOT NULL").distinct()


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def first_tokens(postings: DataFrame) -> DataFrame:
    """``bid, token``: the first token of each bucket, at most one row for each of its 129 numbers."""
    return postings.filter("tf > 0 AND token IS NOT NULL AND docid IS NOT NULL").groupBy(text.bucket(F.col("token")).alias("bid")).agg(F.min("token").alias("token"))


def reachable(frequencies: DataFrame, params: Params = COMPAT, first: DataFrame | None = None) -> DataFrame:
    """Tokens that a lookup finds: all, or in ``compat`` neither the first of a bucket nor those beyond ASCII.

    ``first`` has the first token of each bucket where ``frequencies`` are those of some tokens only.
    """
    if not params.compat:
        return frequencies
    placed = frequencies.withColumn("bid", text.bucket(F.col("token")))
    first = placed.groupBy("bid").agg(F.min("token").alias("token")) if first is None else first
    return placed.filter("bid < 128").join(F.broadcast(first), ["bid", "token"], "left_anti").drop("bid")


def lookup(postings: DataFrame, words: DataFrame) -> DataFrame:
    """The postings of a table of tokens that nothing else reads much of: cleaned rows, each once.

    The tokens' buckets, at most 129 numbers, become a literal filter, which prunes a saved index's
    partitions and a table's row groups; the tokens are joined to the scan before repeated rows go, so
    only postings that are asked for are moved. Beyond ``FEW_WORDS`` tokens the join is shuffled.
    """
    wanted = words.select("token").distinct().withColumn("bid", text.bucket(F.col("token")))
    figures = wanted.agg(F.count(F.lit(1)).alias("n"), F.collect_set("bid").alias("bids")).first()
    asked = postings.filter("tf > 0 AND docid IS NOT NULL").filter(F.col("bid").isin(sorted(figures["bids"])))
    few = F.broadcast(wanted) if figures["n"] <= FEW_WORDS else wanted
    return asked.join(few, ["bid", "token"], "left_semi").distinct()


def known_frequencies(frequencies: DataFrame, words: DataFrame) -> DataFrame:
    """``token, df`` of a table of tokens, out of a saved index's frequencies ``token, bid, df``."""
    wanted = words.select("token").distinct().withColumn("bid", text.bucket(F.col("token")))
    figures = wanted.agg(F.count(F.lit(1)).alias("n"), F.collect_set("bid").alias("bids")).first()
    few = F.broadcast(wanted) if figures["n"] <= FEW_WORDS else wanted
    return frequencies.filter(F.col("bid").isin(sorted(figures["bids"]))).join(few, ["bid", "token"], "left_semi").select("token", "df")


def statistics(docinfo: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: last docid, documents, how many of them have no tokens and how many have, distinct tokens."""
    empty = F.col("total_tokens").isNull() | (F.col("total_tokens") <= 0)
    docs = docinfo.groupBy("docid").agg(F.min(empty.cast("int")).alias("empty"))
    counted = docs.agg(F.max("docid").alias("last_docid"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("empty"), F.lit(0)).alias("n_empty"))
    tokens = postings.agg(F.countDistinct("token").alias("n_tokens"))
    return counted.withColumn("n_nonempty", F.col("n_docs") - F.col("n_empty")).join(F.broadcast(tokens))


def stored_kilobytes(spark: SparkSession, folder: str) -> float:
    """The size of a saved index's files in KB."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength() / 1024


def documents(docinfo: DataFrame) -> DataFrame:
    """One row a document with usable qualities: null and never computed ones (below 0) are 1."""
    quality = lambda c: F.coalesce(F.max(F.when(F.col(c) >= 0, F.col(c))), F.lit(1.0).cast("float")).alias(c)
    rows = docinfo.filter("docid IS NOT NULL").groupBy("docid")
    return rows.agg(F.max("total_tokens").alias("total_tokens"), *[quality(c) for c in ("pr_quality", "hub_quality", "auth_quality")], F.max("url").alias("url"))


def dense(docs: DataFrame) -> DataFrame:
    """All docids from 1 to the last, gaps as empty documents with default qualities."""
    last = docs.agg(F.max("docid")).first()[0] or 0
    ids = docs.sparkSession.range(1, last + 1).withColumnRenamed("id", "docid")
    one = F.lit(1.0).cast("float")
    filled = ids.join(docs.withColumn("_here", F.lit(True)), "docid", "left")
    return filled.select(
        "docid",
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        *[F.coalesce(c, one).alias(c) for c in ("pr_quality", "hub_quality", "auth_quality")],
        F.coalesce("url", F.lit("")).alias("url"),
        F.col("_here").isNull().alias("empty"),
    )

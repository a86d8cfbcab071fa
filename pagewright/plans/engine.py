"""Registered queries of the retrieval and link-analysis operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import hashing, text
from pagewright.operators import dedup, graph, incremental, search, summary
from pagewright.operators import index as ix
from pagewright.params import COMPAT
from pagewright.plans.materialize import materialize, new_path
from pagewright.sources import pages as source
from pagewright.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _clean(spark: SparkSession, directory: str) -> DataFrame:
    return source.clean(source.delivered(spread(spark, directory, "pages")))


def _counts(spark: SparkSession, directory: str) -> DataFrame:
    return ix.token_counts(_clean(spark, directory))


def _stems(spark: SparkSession, directory: str) -> DataFrame:
    counts = materialize(_counts(spark, directory), "token-counts")
    return ix.stemmed_counts(counts, ix.vocabulary(counts))


def _prints(spark: SparkSession, directory: str) -> DataFrame:
    pages = dedup.by_content(dedup.by_url(_clean(spark, directory)))
    counts = materialize(ix.token_counts(pages), "token-counts")
    return ix.fingerprints(pages, counts, ix.vocabulary(counts))


def _open(spark: SparkSession, directory: str) -> search.SearchIndex:
    return search.open_index(table(spark, directory, "postings"), table(spark, directory, "docinfo"))


def _gathered(spark: SparkSession, directory: str, index: search.SearchIndex) -> tuple[DataFrame, DataFrame]:
    """The batch's tokens that count, and their postings."""
    found = search.gather(search.query_tokens(table(spark, directory, "queries")), index)
    return materialize(search.prune(found.tokens, found.frequencies, COMPAT), "pruned"), found.postings


def _scored(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return search.scored(table(spark, directory, "queries"), _open(spark, directory), columns)


def _best(spark: SparkSession, directory: str, k: int | None = None) -> DataFrame:
    return search.search(table(spark, directory, "queries"), _open(spark, directory), k)


def _alternative_best(spark: SparkSession, directory: str) -> DataFrame:
    found = search.alternative_scores(table(spark, directory, "queries"), _open(spark, directory), ("docid", "url", "score"), 5)
    return search.ranked(found, 5)


def _saved(spark: SparkSession, directory: str) -> str:
    """An index of the stored tables, saved as the engine does it."""
    folder = new_path(spark, "index")
    docs = table(spark, directory, "docinfo").select("docid", "total_tokens", "pr_quality", "hub_quality", "auth_quality", "url")
    ix.save(ix.Index(docs, table(spark, directory, "postings"), table(spark, directory, "doclinks")), folder)
    return folder


def _edges(spark: SparkSession, directory: str) -> DataFrame:
    return graph.link_graph(table(spark, directory, "doclinks"), ix.documents(table(spark, directory, "docinfo")))


def _nodes(spark: SparkSession, directory: str) -> DataFrame:
    return ix.dense(ix.documents(table(spark, directory, "docinfo"))).select("docid")


def _summaries(spark: SparkSession, directory: str) -> DataFrame:
    return summary.inputs(_clean(spark, directory)).withColumnRenamed("text", "summary")


@query
def scan_pages(spark: SparkSession, directory: str) -> DataFrame:
    rows = source.delivered(table(spark, directory, "pages"))
    return rows.select("docid", "url", F.octet_length("content").alias("n_bytes"))


@query
def scan_json(spark: SparkSession, directory: str) -> DataFrame:
    """The pages as a folder of JSON files, one a page, scanned again: docids count the files by path."""
    folder = new_path(spark, "json-pages")
    rows = source.delivered(table(spark, directory, "pages")).select("url", "content")
    rows.write.option("maxRecordsPerFile", 1).json(folder)
    return source.scan_json(spark, folder).select("url", F.md5("content").alias("content_md5"))


@query
def clean_pages(spark: SparkSession, directory: str) -> DataFrame:
    return _clean(spark, directory).select("docid", "url", "content")


@query
def html_text(spark: SparkSession, directory: str) -> DataFrame:
    return _clean(spark, directory).select("docid", text.html_text(F.col("content")).alias("text"))


@query
def important_tokens(spark: SparkSession, directory: str) -> DataFrame:
    return ix.important_ranks(_clean(spark, directory)).select("docid", "token", F.col("important").cast("int").alias("important"))


@query
def links(spark: SparkSession, directory: str) -> DataFrame:
    return ix.page_links(_clean(spark, directory))


@query
def url_resolve(spark: SparkSession, directory: str) -> DataFrame:
    found = _clean(spark, directory).select("docid", "url", F.explode(text.hrefs(F.col("content"))).alias("href")).distinct()
    return found.select("docid", "href", text.resolved(F.col("url"), text.decoded(F.col("href"))).alias("resolved"))


@query
def url_defrag(spark: SparkSession, directory: str) -> DataFrame:
    rows = source.delivered(table(spark, directory, "pages"))
    has = F.instr("url", "#") > 0
    fragment = F.when(has, F.substring(F.col("url"), F.instr("url", "#") + 1, F.length("url"))).otherwise("")
    return rows.select("docid", text.defrag(F.col("url")).alias("base"), fragment.alias("fragment"))


@query
def tokenize(spark: SparkSession, directory: str) -> DataFrame:
    rows = spread(spark, directory, "documents").filter("text IS NOT NULL").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "\n")).alias("tokens_md5"))


@query
def ngrams(spark: SparkSession, directory: str) -> DataFrame:
    rows = text.with_ngrams(spread(spark, directory, "documents").filter("text IS NOT NULL"), "text", 2)
    return rows.select("doc_id", F.size("ngrams").alias("n_bigrams"), F.md5(F.array_join("ngrams", "|")).alias("bigrams_md5"))


@query
def ngrams_flat(spark: SparkSession, directory: str) -> DataFrame:
    """A text's tokens followed by its runs of two and of three tokens, as one list."""
    rows = spread(spark, directory, "documents").filter("text IS NOT NULL")
    flat = text.with_flat_ngrams(rows, "text", 3, "flat")
    return flat.select("doc_id", F.size("flat").alias("n"), F.md5(F.array_join("flat", "|")).alias("flat_md5"))


@query
def stem_vocab(spark: SparkSession, directory: str) -> DataFrame:
    return text.stemmed(_counts(spark, directory).select("word").distinct(), "word", "token")


@query
def stopword_flag(spark: SparkSession, directory: str) -> DataFrame:
    stems = stem_vocab(spark, directory).select("token").distinct()
    return stems.select("token", text.is_stopword(F.col("token")).alias("stopword"))


@query
def word_count(spark: SparkSession, directory: str) -> DataFrame:
    return _stems(spark, directory)


@query
def exact_hash(spark: SparkSession, directory: str) -> DataFrame:
    return _clean(spark, directory).select("docid", *hashing.exact_hash(F.col("content")))


@query
def crc64_vocab(spark: SparkSession, directory: str) -> DataFrame:
    words = _counts(spark, directory).select("word").distinct()
    return words.select("word", F.lower(F.lpad(F.hex(hashing.crc64(F.col("word"))), 16, "0")).alias("crc"))


@query
def simhash(spark: SparkSession, directory: str) -> DataFrame:
    return _prints(spark, directory)


@query
def hamming_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return dedup.similar_fingerprints(_prints(spark, directory)).withColumn("bits", F.col("bits").cast("int"))


@query
def dedup_url(spark: SparkSession, directory: str) -> DataFrame:
    return dedup.by_url(_clean(spark, directory)).select("docid", "url")


@query
def dedup_exact(spark: SparkSession, directory: str) -> DataFrame:
    return dedup.by_content(dedup.by_url(_clean(spark, directory))).select("docid", "url")


@query
def dedup_similar(spark: SparkSession, directory: str) -> DataFrame:
    return dedup.by_fingerprint(_prints(spark, directory))


@query
def inverted_index(spark: SparkSession, directory: str) -> DataFrame:
    rows = _stems(spark, directory)
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("docid").alias("first_docid"), F.max("docid").alias("last_docid"))


@query
def doc_freq(spark: SparkSession, directory: str) -> DataFrame:
    return ix.document_frequency(ix.valid_postings(table(spark, directory, "postings")))


@query
def docinfo(spark: SparkSession, directory: str) -> DataFrame:
    return ix.build(_clean(spark, directory)).docinfo


@query
def built_postings(spark: SparkSession, directory: str) -> DataFrame:
    return ix.build(_clean(spark, directory)).postings.withColumn("important", F.col("important").cast("int"))


def _in_batches(spark: SparkSession, directory: str) -> str:
    """An index folder to which the earlier half of all pages was appended, then all of them, of which the half is skipped."""
    pages, folder = materialize(_clean(spark, directory), "pages"), new_path(spark, "batches")
    middle = (pages.agg(F.max("docid")).first()[0] or 0) // 2
    incremental.append(pages.filter(F.col("docid") <= middle), folder, 0)
    incremental.append(pages, folder, 1)
    return folder


@query
def batched_postings(spark: SparkSession, directory: str) -> DataFrame:
    """The postings of an index built in two batches: those of one build."""
    stored = incremental.load(spark, _in_batches(spark, directory)).postings
    return stored.select("bid", "token", "docid", "tf", F.col("important").cast("int").alias("important"))


@query
def resume_point(spark: SparkSession, directory: str) -> DataFrame:
    """Where indexing goes on after a first batch, the earlier half of all pages."""
    pages, folder = materialize(_clean(spark, directory), "pages"), new_path(spark, "batches")
    middle = (pages.agg(F.max("docid")).first()[0] or 0) // 2
    incremental.append(pages.filter(F.col("docid") <= middle), folder, 0)
    return spark.createDataFrame([(incremental.last_docid(spark, folder),)], "last_docid long")


@query
def docinfo_dense(spark: SparkSession, directory: str) -> DataFrame:
    return ix.dense(ix.documents(table(spark, directory, "docinfo")))


@query
def doclinks(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "doclinks").filter("src IS NOT NULL AND dst_url IS NOT NULL").select("src", "dst_url").distinct()


@query
def postings_bucketed(spark: SparkSession, directory: str) -> DataFrame:
    rows = ix.valid_postings(table(spark, directory, "postings")).withColumn("bid", text.bucket(F.col("token")))
    return rows.groupBy("bid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_tokens"), F.min("token").alias("first"), F.max("token").alias("last"))


@query
def lookup_postings(spark: SparkSession, directory: str) -> DataFrame:
    words = materialize(search.query_tokens(table(spark, directory, "queries")), "query-tokens")
    found = ix.lookup(table(spark, directory, "postings"), words)
    return found.select("token", "docid", "tf", F.col("important").cast("int").alias("important"))


@query
def index_stats(spark: SparkSession, directory: str) -> DataFrame:
    docs = ix.documents(table(spark, directory, "docinfo"))
    return ix.statistics(docs, ix.valid_postings(table(spark, directory, "postings")))


@query
def index_append(spark: SparkSession, directory: str) -> DataFrame:
    """Two builds in one: the earlier half of all pages, then the later half."""
    pages = materialize(_clean(spark, directory), "pages")
    middle = (pages.agg(F.max("docid")).first()[0] or 0) // 2
    first = ix.Index(*_plain_index(pages.filter(F.col("docid") <= middle)))
    second = ix.Index(*_plain_index(pages.filter(F.col("docid") > middle)))
    merged = ix.merge(first, second)
    return ix.document_frequency(merged.postings)


def _plain_index(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts = materialize(ix.token_counts(pages), "token-counts")
    bags = ix.stemmed_counts(counts, ix.vocabulary(counts)).withColumn("bid", text.bucket(F.col("token")))
    totals = bags.groupBy("docid").agg(F.count(F.lit(1)).alias("total_tokens"))
    return pages.select("docid", "url").join(totals, "docid", "left"), bags, ix.page_links(pages)


@query
def link_graph(spark: SparkSession, directory: str) -> DataFrame:
    return _edges(spark, directory)


@query
def out_degree(spark: SparkSession, directory: str) -> DataFrame:
    return graph.out_degree(_edges(spark, directory))


@query
def pagerank(spark: SparkSession, directory: str) -> DataFrame:
    return graph.pagerank(_edges(spark, directory), _nodes(spark, directory)).select("docid", F.round("pr", 6).alias("pr"))


@query
def hits(spark: SparkSession, directory: str) -> DataFrame:
    found = graph.hits(_edges(spark, directory), _nodes(spark, directory))
    return found.select("docid", F.round("hub", 6).alias("hub"), F.round("auth", 6).alias("auth"))


@query
def docinfo_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs, edges, nodes = ix.documents(table(spark, directory, "docinfo")), _edges(spark, directory), _nodes(spark, directory)
    new = graph.with_quality(docs, graph.pagerank(edges, nodes), graph.hits(edges, nodes))
    return new.select("docid", "total_tokens", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("pr_quality", "hub_quality", "auth_quality")], "url")


@query
def saved_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """The queries' postings out of a saved index: its buckets are pruned as partitions."""
    words = materialize(search.query_tokens(table(spark, directory, "queries")), "query-tokens")
    found = ix.lookup(ix.load(spark, _saved(spark, directory)).postings, words)
    return found.select("token", "docid", "tf", F.col("important").cast("int").alias("important"))


@query
def saved_search(spark: SparkSession, directory: str) -> DataFrame:
    """The best five pages of each query out of a saved index."""
    index = search.open_saved(spark, _saved(spark, directory))
    return search.search(table(spark, directory, "queries"), index, 5).withColumn("score", F.round("score", 6))


@query
def query_prune(spark: SparkSession, directory: str) -> DataFrame:
    return _gathered(spark, directory, _open(spark, directory))[0]


@query
def match_conjunctive(spark: SparkSession, directory: str) -> DataFrame:
    return search.match(*_gathered(spark, directory, _open(spark, directory)))


@query
def match_intersect(spark: SparkSession, directory: str) -> DataFrame:
    """Queries of two tokens or more: documents that have both the least and the greatest of them."""
    pruned, postings = _gathered(spark, directory, _open(spark, directory))
    two = pruned.groupBy("query_id").agg(F.min("token").alias("s"), F.max("token").alias("t")).filter("s < t")
    docs = lambda c: two.select("query_id", F.col(c).alias("token")).join(postings, "token").select("query_id", "docid")
    return docs("s").intersect(docs("t"))


def _score_query(name: str, column: str) -> None:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return _scored(spark, directory, "docid", column).withColumn(column, F.round(column, 6))

    run.__name__ = name
    query(run)


for _name, _column in (("score_tfidf", "tfidf"), ("score_cosine", "cosine"), ("score_relevance", "relevance"), ("score_quality", "quality"), ("score_net", "score")):
    _score_query(_name, _column)


@query
def search_full(spark: SparkSession, directory: str) -> DataFrame:
    return _best(spark, directory).withColumn("score", F.round("score", 6))


@query
def search_topk(spark: SparkSession, directory: str) -> DataFrame:
    return _best(spark, directory, 5).withColumn("score", F.round("score", 6))


@query
def format_tty(spark: SparkSession, directory: str) -> DataFrame:
    return search.format_tty(_best(spark, directory, 5))


@query
def format_web(spark: SparkSession, directory: str) -> DataFrame:
    return search.format_web(_best(spark, directory, 5), _summaries(spark, directory))


@query
def alt_score(spark: SparkSession, directory: str) -> DataFrame:
    found = search.alternative_scores(table(spark, directory, "queries"), _open(spark, directory), ("docid", "cosine", "score"))
    return found.select("query_id", "docid", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query
def alt_search(spark: SparkSession, directory: str) -> DataFrame:
    return _alternative_best(spark, directory).withColumn("score", F.round("score", 6))


@query
def format_alternative(spark: SparkSession, directory: str) -> DataFrame:
    return search.format_alternative(_alternative_best(spark, directory))


@query
def summarize(spark: SparkSession, directory: str) -> DataFrame:
    """Each page's summary by the offline default model."""
    return summary.summarize(_clean(spark, directory))


@query
def summary_latest(spark: SparkSession, directory: str) -> DataFrame:
    """Of a store to which summaries of all arrivals of a page were appended, the last one of each page."""
    rows = table(spark, directory, "pages").filter("docid IS NOT NULL AND ingested_at IS NOT NULL")
    return summary.latest(rows.select("docid", F.coalesce("url", F.lit("")).alias("summary"), F.struct("ingested_at", F.coalesce("url", F.lit(""))).alias("seq")))


@query
def summary_input(spark: SparkSession, directory: str) -> DataFrame:
    return summary.inputs(_clean(spark, directory))


@query
def summary_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return summary.lookup(table(spark, directory, "pages").select("docid").distinct(), _summaries(spark, directory))

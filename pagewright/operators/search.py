"""Answering batches of keyword queries: conjunctive matches, relevance and quality scores, ranks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import index as ix
from pagewright.operators import matching
from pagewright.operators.ranking import row_number_within
from pagewright.params import COMPAT, Params
from pagewright.plans.materialize import discard, materialize, materialize_counted


@dataclass(frozen=True)
class SearchIndex:
    """What queries are answered from: postings as stored, the first token of each bucket, documents.

    ``frequencies`` is there for a saved index only; otherwise a batch counts those of its own tokens.
    """

    postings: DataFrame
    first: DataFrame
    docs: DataFrame
    n_docs: int
    params: Params = COMPAT
    frequencies: DataFrame | None = None


def open_index(postings: DataFrame, docinfo: DataFrame, params: Params = COMPAT) -> SearchIndex:
    """An index over stored tables, in which repeated and invalid rows and unusable qualities are met."""
    docs, n = materialize_counted(ix.documents(docinfo), "documents")
    return SearchIndex(postings, ix.first_tokens(postings), docs, n, params)


def open_saved(spark: SparkSession, folder: str, params: Params = COMPAT) -> SearchIndex:
    """A saved index; its frequencies and buckets are read from their own table, no postings are."""
    stored = ix.load(spark, folder)
    frequencies = spark.read.parquet(f"{folder}/frequencies")
    first = materialize(frequencies.groupBy("bid").agg(F.min("token").alias("token")), "first-tokens")
    docs, n = materialize_counted(ix.documents(stored.docinfo), "documents")
    return SearchIndex(stored.postings, first, docs, n, params, frequencies.select("token", "bid", "df"))


@dataclass(frozen=True)
class Gathered:
    """A batch's tokens with all that the index has on them: one scan of the postings, written."""

    tokens: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def gather(tokens: DataFrame, index: SearchIndex) -> Gathered:
    """Look a batch's tokens up: their postings, each once, and the document frequencies that can be reached."""
    tokens = materialize(tokens, "query-tokens")
    found = materialize(ix.lookup(index.postings, tokens).select("token", "docid", "tf", "important"), "found-postings")
    if index.frequencies is None:
        counted = ix.document_frequency(found)
    else:
        counted = ix.known_frequencies(index.frequencies, tokens)
    return Gathered(tokens, found, ix.reachable(counted, index.params, index.first))


def query_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, token, qtf``: stems of each query; null and empty queries have none."""
    words = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(text.tokens(F.col("query"))).alias("word"))
    stems = text.stemmed(words.select("word").distinct(), "word", "token")
    return words.join(stems, "word").groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def prune(tokens: DataFrame, frequencies: DataFrame, params: Params = COMPAT) -> DataFrame:
    """The tokens that a query is answered with: ``query_id, token, qtf, df``.

    Tokens without postings go, alphanumeric ones counting against the query; a query with more than
    ``junk_factor`` times as many of these as of others has no tokens left. Stopwords go as well, but
    where they make up ``stopword_share`` of the tokens the log2 of their number stay, the rarest first.
    """
    known = tokens.join(frequencies, "token", "left").withColumn("stop", text.is_stopword(F.col("token")) & F.col("df").isNotNull())
    query = Window.partitionBy("query_id")
    lost = F.col("df").isNull() & text.is_alphanumeric(F.col("token"))
    counted = known.withColumns(
        {
            "lost": F.coalesce(F.sum(F.when(lost, F.col("qtf"))).over(query), F.lit(0)),
            "valid": F.coalesce(F.sum(F.when(F.col("df").isNotNull(), F.col("qtf"))).over(query), F.lit(0)),
            "n_valid": F.sum(F.when(F.col("df").isNotNull(), 1).otherwise(0)).over(query),
            "n_stop": F.sum(F.col("stop").cast("int")).over(query),
            "place": F.row_number().over(Window.partitionBy("query_id", "stop").orderBy("df", "qtf", "token")),
        }
    )
    most = F.when(F.col("n_stop") >= F.col("n_valid") * params.stopword_share, F.length(F.bin("n_stop")) - 1).otherwise(0)
    good = F.col("df").isNotNull() & (F.col("lost") <= F.col("valid") * params.junk_factor)
    return counted.filter(good & (~F.col("stop") | (F.col("place") <= most))).select("query_id", "token", "qtf", "df")


def match(pruned: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, docid`` of documents that have all of a query's tokens."""
    every = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    asked = _small(pruned, pruned.select("query_id", "token", every.alias("needed")))
    found = postings.select("token", "docid").join(asked, "token").groupBy("query_id", "docid")
    return found.agg(F.count(F.lit(1)).alias("have"), F.max("needed").alias("needed")).filter("have = needed").select("query_id", "docid")


def _small(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """What is asked of a batch's tokens, one row each, broadcast if they are few: the postings of a token that is everywhere stay where they are."""
    return F.broadcast(asked) if tokens.count() <= ix.FEW_WORDS else asked


def _relevance_scorer(index: SearchIndex) -> matching.Scorer:
    """Relevance and quality of a block's documents; a bag's norms make them comparable."""
    p, n = index.params, index.n_docs

    def figures(block: matching.Block, docs: dict[str, np.ndarray], bags: matching.Bags) -> list[np.ndarray]:
        _, at, w, both, ww, qq = block
        length = np.sqrt(ww) * np.sqrt(qq)
        return [w / docs["total_tokens"][at], np.where(length > 0, both / length, 0.0), *[docs[c][at] for c in matching.QUALITIES]]

    def columns(figures: list[np.ndarray], m: int, norms: np.ndarray) -> dict[str, np.ndarray]:
        tf_sum, cosine = figures[:2]
        scale = math.log((1.0 + n) / (1.0 + m)) if p.compat else 1.0
        share = [np.zeros(len(x)) if norm == 0 else x / norm for x, norm in zip(figures, norms, strict=True)]
        cosine = cosine if scale > 0 else np.zeros(len(cosine))
        relevance = np.where(cosine > p.cosine_gate, p.tfidf_weight * share[0] + (1 - p.tfidf_weight) * share[1], 0.0)
        quality = p.pagerank_weight * share[2] + p.hub_weight * share[3] + p.authority_weight * share[4]
        score = p.relevance_weight * relevance + (1 - p.relevance_weight) * quality
        return {"tfidf": tf_sum * scale, "cosine": cosine, "relevance": relevance, "quality": quality, "score": score}

    return matching.Scorer(figures, columns, 5, greatest=False)


def _matches(pruned: DataFrame, index: SearchIndex, postings: DataFrame | None) -> matching.Batch:
    p, n = index.params, index.n_docs
    postings = ix.lookup(index.postings, pruned) if postings is None else postings
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in p.importance]), F.col("important") + 1)
    if p.compat:
        weighted, wq = postings.withColumn("w", F.col("tf") * weight), F.col("qtf").cast("double")
    else:
        idf = F.ln((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df")))
        of_token = pruned.groupBy("token").agg(F.max("df").alias("df"))
        weighted, wq = postings.join(_small(pruned, of_token), "token").withColumn("w", F.col("tf") * weight * idf), F.col("qtf") * idf
    return matching.batch(pruned.select("query_id", "token", wq.alias("wq")), weighted.select("token", "docid", "w"), index.docs.filter("total_tokens > 0"))


_SCORES = ("docid", "url", "tfidf", "cosine", "relevance", "quality", "score")


def scores(pruned: DataFrame, index: SearchIndex, postings: DataFrame | None = None, columns: tuple[str, ...] = _SCORES, k: int | None = None) -> DataFrame:
    """All scores of all matches: ``query_id, docid, url, tfidf, cosine, relevance, quality, score``.

    One idf a query from its result's size (``compat``) or one a token from the collection; weights of a
    token in a document, their sum and their cosine with the query; both normalised over the result and
    mixed, unless the cosine misses the gate; the qualities normalised and mixed likewise. ``postings``
    are those of the batch's tokens if they have been looked up already. Matches are found twice, for the
    norms and for the scores, and neither moved nor written. With ``k`` rows that are not among the best
    ``k`` of a query may be missing.
    """
    return matching.scored(_matches(pruned, index, postings), _relevance_scorer(index), columns, k)


def ordered(pruned: DataFrame, index: SearchIndex, postings: DataFrame | None = None) -> DataFrame:
    """All matches in order, as ``ranked`` numbers them: ``query_id, rank, docid, url, score``."""
    out = matching.ordered(_matches(pruned, index, postings), _relevance_scorer(index))
    return out.withColumn("rank", F.col("rank").cast("int"))


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, rank, docid, url, score``, best first, ties by docid; the best ``k`` only if given.

    With ``k`` each task keeps its own best ``k`` of a query before they are moved. Without, rows are
    ranged by query, score and docid and numbered range by range, so no task sorts all of a query's.
    """
    rounded = scored.select("query_id", "docid", "url", "score", (-F.round("score", 9)).alias("_less"))
    if k is not None:
        order = Window.partitionBy("query_id").orderBy("_less", "docid")
        out = rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    else:
        out = row_number_within(rounded, "query_id", ["_less", "docid"], "rank")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "docid", "url", "score")


def _asked(queries: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame]:
    """The tokens that a batch of queries ``query_id, query`` is answered with, and their postings."""
    found = gather(query_tokens(queries), index)
    return materialize(prune(found.tokens, found.frequencies, index.params), "pruned"), found.postings


def scored(queries: DataFrame, index: SearchIndex, columns: tuple[str, ...] = _SCORES, k: int | None = None) -> DataFrame:
    """The scores of all matches of a batch of queries ``query_id, query``."""
    pruned, postings = _asked(queries, index)
    out = scores(pruned, index, postings, columns, k)
    discard(postings)
    return out


def search(queries: DataFrame, index: SearchIndex, k: int | None = None) -> DataFrame:
    """Answer a batch of queries ``query_id, query``: all matches in order, or the best ``k``."""
    if k is not None:
        return ranked(scored(queries, index, ("docid", "url", "score"), k), k)
    pruned, postings = _asked(queries, index)
    out = ordered(pruned, index, postings)
    discard(postings)
    return out


def _url() -> Column:
    return F.when(F.length("url") > 0, F.col("url")).otherwise("URL not found")


def format_tty(results: DataFrame) -> DataFrame:
    line = F.format_string("Rank %d: %s (Score: %.2f)", F.col("rank"), _url(), F.col("score"))
    return results.select("query_id", "rank", line.alias("line"))


def _escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def format_web(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """One HTML line a result, with its summary or a note that there is none; texts are escaped."""
    joined = results.join(summaries, "docid", "left")
    summary = F.when(F.length("summary") > 0, F.col("summary")).otherwise("Summary not found")
    link = '%d. <a href="%s" target="_blank">%s</a> (Score: %.2f)<br>Summary: %s'
    line = F.format_string(link, F.col("rank"), _escaped(_url()), _escaped(_url()), F.col("score"), _escaped(summary))
    return joined.select("query_id", "rank", line.alias("line"))


def alternative_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, token, qn``: words parted by white space, stopwords (as written) out, stemmed; ``qn``
    is how often the stem stands in the raw query as a string."""
    words = queries.filter("query_id IS NOT NULL").select("query_id", "query", F.explode(F.split(text.collapse(F.col("query")), " ")).alias("raw"))
    words = words.filter((F.length("raw") > 0) & ~text.is_stopword(F.col("raw"))).withColumn("word", F.lower("raw"))
    stems = text.stemmed(words.select("word").distinct(), "word", "token")
    joined = words.join(stems, "word").select("query_id", "query", "token").distinct()
    shorter = F.length("query") - F.length(F.replace(F.col("query"), F.col("token"), F.lit("")))
    return joined.select("query_id", "token", (shorter / F.length("token")).cast("int").alias("qn"))


def format_alternative(results: DataFrame) -> DataFrame:
    """The alternate scorer's lines: a numbered link with its score."""
    line = F.format_string('%d. <a href="%s" target="_blank">%s</a> (Score: %.2f)', F.col("rank"), _escaped(_url()), _escaped(_url()), F.col("score"))
    return results.select("query_id", "rank", line.alias("line"))


def _alternative_scorer() -> matching.Scorer:
    def figures(block: matching.Block, docs: dict[str, np.ndarray], bags: matching.Bags) -> list[np.ndarray]:
        return [docs[c][block[1]] for c in matching.QUALITIES] + [_alternative_cosine(block, bags)]

    def columns(figures: list[np.ndarray], m: int, greatest: np.ndarray) -> dict[str, np.ndarray]:
        over = [np.zeros(len(x)) if most == 0 else x / most for x, most in zip(figures[:3], greatest[:3], strict=True)]
        return {"cosine": figures[3], "score": figures[3] + over[0] + over[1] + over[2]}

    return matching.Scorer(figures, columns, 4, greatest=True)


def _alternative_cosine(block: matching.Block, bags: matching.Bags) -> np.ndarray:
    bag, _, _, both, ww, _ = block
    length = np.sqrt(ww) * bags.lengths[bag]
    return np.where(length > 0, both / length, 0.0)


def alternative_scores(queries: DataFrame, index: SearchIndex, columns: tuple[str, ...] = ("docid", "url", "cosine", "score"), k: int | None = None) -> DataFrame:
    """The alternate scorer: ``query_id, docid, url, cosine, score``.

    Log-weighted counts, important text by 1.2, idf from the collection; words without postings do not
    matter; the score is the cosine plus each quality over its greatest in the result. With ``k`` rows
    that are not among the best ``k`` of a query may be missing.
    """
    found = gather(alternative_tokens(queries), index)
    idf = F.log2((F.lit(1.0) + index.n_docs) / (F.lit(1.0) + F.col("df")))
    weighted = found.tokens.join(found.frequencies, "token")
    asked = weighted.select("query_id", "token", (F.when(F.col("qn") > 0, 1 + F.ln("qn")).otherwise(0.0) * idf).alias("wq"))
    wd = (1 + F.ln("tf")) * F.when(F.col("important") > 0, 1.2).otherwise(1.0)
    postings = found.postings.select("token", "docid", wd.alias("w"))
    answered = matching.batch(asked, postings, index.docs)
    discard(found.postings)
    return matching.scored(answered, _alternative_scorer(), columns, k)

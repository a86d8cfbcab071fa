"""Command line: ``python -m pagewright.cli index|rank|search|summarize|stats|compact``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from pagewright.operators import search
from pagewright.plans.materialize import materialize


def _session() -> SparkSession:
    return SparkSession.builder.appName("pagewright").getOrCreate()


def _rank(spark: SparkSession, folder: str) -> None:
    from pagewright.operators import graph, index

    stored = index.load(spark, folder)
    docs = index.documents(stored.docinfo)
    edges, nodes = graph.link_graph(stored.doclinks, docs), index.dense(docs).select("docid")
    graph.with_quality(docs, graph.pagerank(edges, nodes), graph.hits(edges, nodes)).write.mode("overwrite").parquet(f"{folder}/docinfo.ranked")


def _answer(spark: SparkSession, opened: search.SearchIndex, query: str) -> None:
    """Print how many results a query has, the best five and the time it took."""
    began = time.time()
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    scored = materialize(search.scored(asked, opened), "results")
    print(f"Number of results: {scored.count()}")
    for row in search.format_tty(search.ranked(scored, 5)).orderBy("rank").collect():
        print(row["line"])
    print(f"Query time: {(time.time() - began) * 1000:.2f} milliseconds")


def _converse(spark: SparkSession, opened: search.SearchIndex) -> None:
    """Answer one line of input after another over one opened index, until input ends; empty lines are passed over."""
    while True:
        try:
            query = input("Enter query:")
        except EOFError:
            return
        if query:
            _answer(spark, opened, query)


def main(arguments: list[str] | None = None) -> None:
    from pagewright.operators import index, summary
    from pagewright.sources import compaction, pages

    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, others in {"index": ["pages", "folder"], "rank": ["folder"], "search": ["folder", "query"], "summarize": ["pages", "out"], "stats": ["folder"], "compact": ["source", "target"]}.items():
        sub = commands.add_parser(name)
        for other in others:
            sub.add_argument(other, nargs="?" if other == "query" else None)
    given = parser.parse_args(arguments)
    spark, began = _session(), time.time()
    if given.command == "index":
        index.save(index.build(pages.clean(pages.scan_json(spark, given.pages))), given.folder)
    elif given.command == "rank":
        _rank(spark, given.folder)
    elif given.command == "summarize":
        summary.summarize(pages.clean(pages.scan_json(spark, given.pages))).write.mode("append").parquet(given.out)
    elif given.command == "compact":
        compaction.compact_files(spark, given.source, given.target)
    elif given.command == "stats":
        stored = index.load(spark, given.folder)
        row = index.statistics(index.documents(stored.docinfo), stored.postings).first()
        print(f"Number of unique words: {row['n_tokens']}\nNumber of documents: {row['n_docs']} ({row['n_empty']} empty, {row['n_nonempty']} not)")
        print(f"Size of index: {index.stored_kilobytes(spark, given.folder):.2f} KB")
    else:
        opened = search.open_saved(spark, given.folder)
        if given.query:
            _answer(spark, opened, given.query)
        else:
            _converse(spark, opened)
    print(f"{(time.time() - began) * 1000:.0f} ms")


if __name__ == "__main__":
    main()

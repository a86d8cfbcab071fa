"""Answers of a batch in which every query matches many documents, compared with SQL; matches are not written."""

import itertools
import os
import time
from datetime import datetime

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from pagewright.operators import index as ix
from pagewright.operators import matching
from pagewright.plans.materialize import materialize, shared_folder

WORDS = ("boat", "bird", "corn", "cat", "dog", "drum", "fish", "frog", "goat", "gold", "hat", "hill")
N_DOCS, N_MATCHING = 400, 200
NAMES = ("alt_search", "search_topk", "alt_score", "saved_search", "score_quality", "search_full", "format_web", "score_net", "format_alternative", "format_tty", "score_cosine", "score_relevance", "score_tfidf")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many-matches"))
    count = lambda d, word: 1 + (d * 7 + len(word) * WORDS.index(word)) % 5
    postings = [(ord(w[0]), w, d, count(d, w), d % 9) for d in range(1, N_MATCHING + 1) for w in WORDS if d % 10 or w != "dog"]
    postings += [(ord(w[0]), w[0], 1, 1, 0) for w in WORDS]  # the first of a bucket is out of reach
    postings += [(ord(w[0]), w, d, 9, 0) for d in (3, 20, 30) for w in ("boat", "hill")]  # counted again
    postings += postings[:50] + [(98, "boat", 5, 0, 0), (98, None, 5, 1, 0), (98, "boat", None, 1, 0)]
    docs = [(d, 0 if d == 7 else 12 + d % 4, d % 11 / 10 if d % 13 else None, d % 5 / 4 if d % 17 else -1.0, 0.0, f"http://h.test/{d}") for d in range(1, N_DOCS + 1)]
    queries = [(k, f"{a} {b}") for k, (a, b) in enumerate(itertools.combinations(WORDS, 2))]
    queries += [(100 + k, q) for k, q in enumerate(("boat", "hill boat", "boat hill", "boat boat hill", "dog nothing", "dog boat hill the", None, ""))]
    pages = [(d, f"http://h.test/{d}", f"<p>page {d} &amp; more</p>", 1, "en", datetime(2024, 1, 1), datetime(2024, 1, 2)) for d in range(1, 50)]
    for name, rows, schema in (
        ("postings", postings, "bid int, token string, docid long, tf int, important byte"),
        ("docinfo", docs, "docid long, total_tokens int, pr_quality float, hub_quality float, auth_quality float, url string"),
        ("queries", queries, "query_id long, query string"),
        ("pages", pages, "docid long, url string, content string, site_id int, lang string, fetched_at timestamp, ingested_at timestamp"),
        ("doclinks", [(1, "http://h.test/2")], "src long, dst_url string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return folder


def wanted(folder, name):
    connection = duckdb.connect()
    for table in os.listdir(folder):
        connection.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    return sorted(connection.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def written(spark):
    """Rows of each table in the session's shared folder."""
    root, rows = shared_folder(spark).removeprefix("file://"), {}
    for at, _, files in os.walk(root):
        table = os.path.relpath(at, root).split("/")[0]
        rows[table] = rows.get(table, 0) + sum(pq.read_metadata(f"{at}/{f}").num_rows for f in files if f.endswith(".parquet"))
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_matches_are_not_written(spark, tables, name):
    before = written(spark)
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, tables).collect())
    assert got == wanted(tables, name)
    assert max(n for table, n in written(spark).items() if table not in before) < 66 * N_MATCHING // 2


def test_slices_and_large_bags(spark, tables, monkeypatch):
    """Bags sent in several slices, and bags of too many matches for one task, give the same order."""
    monkeypatch.setattr(matching, "SLICE", 40)
    monkeypatch.setattr(matching, "FEW_MATCHES", 150)
    monkeypatch.setattr(matching, "FEW_DOCS", 1)
    got = sorted(tuple(r) for r in __spark_entry__.queries()["search_full"](spark, tables).collect())
    assert got == wanted(tables, "search_full")


def shuffle_files(spark):
    """Files of shuffles that are still on the disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "shuffle_" in x}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = materialize(spark.range(10_000).repartition(4, "id").groupBy("id").count(), "counted")
    ends = time.time() + 20
    while (left := {x for x in shuffle_files(spark) - before if x.endswith(".data")}) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert len(out.collect()) == 10_000


def test_saved_postings_are_moved_once(spark, tables):
    spread = ix.spread_postings(spark.read.parquet(f"{tables}/postings.parquet"))
    assert spread._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {tuple(r) for r in spread.select("bid", "token", "docid", "tf", "important").collect()}
    assert len(rows) == spread.count() == duckdb.sql(f"SELECT count(*) FROM (SELECT DISTINCT * FROM '{tables}/postings.parquet/*.parquet' WHERE tf > 0 AND token IS NOT NULL AND docid IS NOT NULL)").fetchall()[0][0]


@pytest.mark.parametrize("name", ["saved_search", "score_cosine", "score_relevance", "score_net", "score_tfidf", "alt_score", "search_full"])
def test_found_postings_go_once_packed(spark, tables, name):
    before = written(spark)
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, tables).collect())
    assert got == wanted(tables, name)
    assert not [table for table in set(written(spark)) - set(before) if table.startswith("found-postings")]

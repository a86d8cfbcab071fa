import math

import pytest
from pyspark.sql import functions as F

from pagewright.operators import dedup, graph, index, search, summary
from pagewright.params import COMPAT, INTENDED, Params


def pages(spark, rows):
    return spark.createDataFrame(rows, "docid long, url string, content string")


def ids(df):
    return sorted(r.docid for r in df.select("docid").collect())


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        Params(hub_weight=0.5)
    with pytest.raises(ValueError):
        Params(profile="other")


def test_fragments_part_addresses_in_compat_only(spark):
    rows = pages(spark, [(1, "u#a", "x"), (2, "u#b", "y"), (3, "u#a", "z")])
    assert ids(dedup.by_url(rows)) == [1, 2]
    assert ids(dedup.by_url(rows, INTENDED)) == [1]


def test_a_dropped_page_registers_its_address(spark):
    rows = pages(spark, [(1, "a", "same"), (2, "b", "same"), (3, "b", "new")])
    assert ids(dedup.by_content(dedup.by_url(rows))) == [1]


def prints(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "docid long, fp long")


def test_window_of_kept_fingerprints(spark):
    far = [(k * 2654435761) & 0xFFFFFFFF for k in range(1, 400)]
    spread = [0]
    for f in far:
        if all(bin(f ^ g).count("1") > 3 for g in spread):
            spread.append(f)
        if len(spread) == 201:
            break
    assert len(spread) == 201
    kept = ids(dedup.by_fingerprint(prints(spark, [*spread, spread[0] ^ 1, spread[2] ^ 1])))
    assert kept == list(range(1, 203))


def test_a_dropped_near_copy_leaves_no_trace(spark):
    assert ids(dedup.by_fingerprint(prints(spark, [0b0, 0b111, 0b111111]))) == [1, 3]


def test_similar_fingerprints_like_brute_force(spark):
    values = [(k * 40503) & 0xFFFF | (k % 7) << 20 for k in range(300)]
    got = {(r.fp_a, r.fp_b) for r in dedup.similar_fingerprints(prints(spark, values)).collect()}
    distinct = sorted(set(values))
    assert got == {(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 3}


TOY = [(1, 2), (1, 3), (2, 3), (3, 1), (5, 5), (5, 1)]


def test_pagerank_and_hits_golden(spark):
    edges = spark.createDataFrame(TOY, "src long, dst long")
    nodes = spark.range(1, 6).withColumnRenamed("id", "docid")
    pr = {r.docid: r.pr for r in graph.pagerank(edges, nodes).collect()}
    assert pr == pytest.approx({1: 1.475615, 2: 0.775485, 3: 1.432997, 4: 0.15, 5: 0.260870}, abs=1e-5)
    both = {r.docid: (r.hub, r.auth) for r in graph.hits(edges, nodes).collect()}
    for docid, want in {1: 0.296622, 2: 0.169025, 3: 0.223916, 4: 0.0, 5: 0.912857}.items():
        assert both[docid] == pytest.approx((want, want), abs=1e-5)


def test_no_links(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    nodes = spark.range(1, 4).withColumnRenamed("id", "docid")
    assert [r.pr for r in graph.pagerank(edges, nodes).collect()] == pytest.approx([0.15] * 3)
    assert {r.hub for r in graph.hits(edges, nodes).collect()} == {0.0}


def golden(spark, extra_docs=1, params=COMPAT):
    postings = spark.createDataFrame(
        [(120, "x", 1, 2, 0), (120, "x", 2, 1, 0), (120, "x", 3, 1, 0), (121, "y", 1, 1, 0), (121, "y", 2, 1, 0), (121, "y", 3, 9, 0)],
        "bid int, token string, docid long, tf int, important byte",
    )
    docs = [(1, 4, 0.5, 0.6, 0.6, "u1"), (2, 2, 1.0, 0.8, 0.8, "u2"), (3, 5, 0.25, 0.0, 0.0, "u3")] + [(4, 7, 1.0, 1.0, 1.0, "u4")] * extra_docs
    docinfo = spark.createDataFrame(docs, "docid long, total_tokens int, pr_quality float, hub_quality float, auth_quality float, url string")
    pruned = spark.createDataFrame([(1, "x", 1, 3), (1, "y", 1, 3)], "query_id long, token string, qtf long, df long")
    return pruned, search.open_index(postings, docinfo, params)


def test_scores_golden(spark):
    pruned, opened = golden(spark)
    got = {r.docid: r for r in search.scores(pruned, opened).collect()}
    want = {1: (0.133886, 0.948683, 0.393824, 0.503497, 0.436597), 2: (0.178515, 1.0, 0.479950, 0.842994, 0.621537), 3: (0.357030, 0.780869, 0.752123, 0.128749, 0.509007)}
    for docid, values in want.items():
        r = got[docid]
        assert (r.tfidf, r.cosine, r.relevance, r.quality, r.score) == pytest.approx(values, abs=2e-6)
    assert [r.docid for r in search.ranked(search.scores(pruned, opened)).orderBy("rank").collect()] == [2, 3, 1]


def test_all_documents_match(spark):
    pruned, opened = golden(spark, extra_docs=0)
    for r in search.scores(pruned, opened).collect():
        assert r.relevance == 0 and r.score == pytest.approx(0.39 * r.quality) and not math.isnan(r.score)


def pruned(spark, query, frequencies):
    freq = spark.createDataFrame(frequencies, "token string, df long")
    tokens = search.query_tokens(spark.createDataFrame([(1, query)], "query_id long, query string"))
    return sorted(r.token for r in search.prune(tokens, freq).collect())


def test_stopword_rules(spark):
    assert pruned(spark, "the", [("the", 9)]) == []
    assert pruned(spark, "the of", [("the", 9), ("of", 5)]) == ["of"]
    assert pruned(spark, "the apple pear plum", [("the", 9), ("appl", 1), ("pear", 1), ("plum", 1)]) == ["appl", "pear", "plum"]
    assert pruned(spark, "this", [("thi", 3)]) == ["thi"]


def test_junk_gate(spark):
    known = [("appl", 1), ("pear", 1)]
    assert pruned(spark, "q1 q2 q3 q4 q5 apple pear", known) == []
    assert pruned(spark, "q1 q2 q3 q4 apple pear", known) == ["appl", "pear"]
    assert pruned(spark, "?? -- () <> ;; apple", known) == ["appl"]


def test_empty_queries(spark):
    queries = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "apple")], "query_id long, query string")
    assert search.query_tokens(queries).count() == 0


def test_reach(spark):
    freq = spark.createDataFrame([("a", 1), ("ab", 2), ("été", 3)], "token string, df long")
    assert [r.token for r in index.reachable(freq).collect()] == ["ab"]
    assert index.reachable(freq, INTENDED).count() == 3


def test_dense_documents(spark):
    docs = index.documents(spark.createDataFrame([(1, 5, None, -1.0, 0.5, "u"), (4, 6, 2.0, 2.0, 2.0, "v"), (4, 6, 2.0, 2.0, 2.0, "v")], "docid long, total_tokens int, pr_quality float, hub_quality float, auth_quality float, url string"))
    rows = {r.docid: r for r in index.dense(docs).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[1].pr_quality == 1.0 and rows[1].hub_quality == 1.0 and rows[2].empty and not rows[4].empty


def test_build_save_merge(spark, tmp_path):
    first = pages(spark, [(1, "http://h.test/1", "<title>Graph theory</title><p>graph graph trees</p>"), (2, "http://h.test/2", "<p>cooking rice with beans and salt</p><a href='/1'>x</a>")])
    built = index.build(first)
    index.save(built, str(tmp_path / "ix"))
    loaded = index.load(spark, str(tmp_path / "ix"))
    assert {r.docid for r in loaded.docinfo.collect()} == {1, 2}
    assert loaded.doclinks.first().dst_url == "http://h.test/1"
    assert loaded.postings.filter("token = 'graph'").first().tf == 2
    other = index.build(pages(spark, [(2, "http://h.test/2", "<p>painting walls green</p>")]))
    both = index.merge(loaded, other)
    assert both.postings.filter("token = 'rice'").count() == 0 and both.postings.filter("token = 'paint'").count() == 1
    ranks = {r.token: r.important for r in index.build(first, INTENDED).postings.filter("docid = 1").collect()}
    assert ranks["theori"] == 1 and ranks["graph"] == 1 and ranks["tree"] == 0


def test_formats(spark):
    results = spark.createDataFrame([(1, 1, 7, "http://a/?x=<1>&y", 0.5), (1, 2, 8, "", 0.25)], "query_id long, rank int, docid long, url string, score double")
    assert [r.line for r in search.format_tty(results).orderBy("rank").collect()] == ["Rank 1: http://a/?x=<1>&y (Score: 0.50)", "Rank 2: URL not found (Score: 0.25)"]
    web = search.format_web(results, spark.createDataFrame([(7, 'say "hi"')], "docid long, summary string")).orderBy("rank").collect()
    assert "&lt;1&gt;&amp;y" in web[0].line and "say &quot;hi&quot;" in web[0].line and web[1].line.endswith("Summary not found")


def test_summaries(spark):
    rows = pages(spark, [(1, "u", "<p>one  two</p>\n three"), (2, "v", "<p> </p>")])
    assert {r.docid: r.summary for r in summary.summarize(rows).collect()} == {1: "one two three"}
    stored = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "docid long, summary string, seq int")
    found = summary.lookup(rows.select("docid"), summary.latest(stored))
    assert {r.docid: r.summary for r in found.collect()} == {1: "new", 2: "Summary not found"}


def test_same_result_for_any_number_of_partitions(spark):
    pruned_, opened = golden(spark)
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append([tuple(r) for r in search.ranked(search.scores(pruned_, opened)).select("rank", "docid", F.round("score", 9)).orderBy("rank").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


PAGES = [
    (1, "http://h.test/1", "<title>Ferry times</title><p>The ferry leaves at noon. <a href='/2'>More</a></p>"),
    (2, "http://h.test/2", "<h1>Harbour</h1><p>A harbour with a ferry &amp; boats, zebra of zinc</p><a href='../1#x'>back</a>"),
    (3, "http://h.test/3", "<b>Ferry</b><p>the ferry again; <i>harbour</i> lights of zebra</p>"),
]


def built(spark, params):
    return index.build(spark.createDataFrame(PAGES, "docid long, url string, content string"), params)


@pytest.mark.parametrize("parser", [False, True])
def test_saved_index_answers_like_tables(spark, tmp_path, parser):
    """Saved buckets are pruned, frequencies come from their own table; both ways of reading HTML find the same."""
    params = Params(profile="intended", parser=parser)
    made, folder = built(spark, params), str(tmp_path / "ix")
    index.save(made, folder)
    asked = spark.createDataFrame([(1, "ferry harbour"), (2, "zebra"), (3, "nothing here"), (4, None)], "query_id long, query string")
    rows = lambda opened: sorted(tuple(r) for r in search.search(asked, opened, 5).collect())
    saved = rows(search.open_saved(spark, folder, params))
    assert saved == rows(search.open_index(made.postings, made.docinfo, params))
    assert {r[0] for r in saved} == {1, 2} and sorted(r[2] for r in saved if r[0] == 1) == [2, 3]
    important = {(r.token, r.docid): r.important for r in made.postings.filter("important > 0").collect()}
    assert important["ferri", 1] == 1 and important["harbour", 2] == 2 and important["ferri", 3] == 6
    assert {tuple(r) for r in made.doclinks.collect()} == {(1, "http://h.test/2"), (2, "http://h.test/1")}
    plan = index.lookup(index.load(spark, folder).postings, spark.createDataFrame([("zebra",)], "token string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bid" in plan or "bid#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.stored_kilobytes(spark, folder) > 1


def test_statistics_count_empty_documents(spark):
    docs = spark.createDataFrame([(1, 5), (2, 0), (4, None), (4, None)], "docid long, total_tokens int")
    postings = spark.createDataFrame([("a", 1), ("b", 1), ("a", 4)], "token string, docid long")
    row = index.statistics(docs, postings).first()
    assert (row.last_docid, row.n_docs, row.n_empty, row.n_nonempty, row.n_tokens) == (4, 3, 2, 1, 2)


def test_one_query_with_most_matches(spark):
    """Full rankings are numbered range by range; they agree with one window."""
    rows = [(1 if k % 3 else 2, k, f"u{k}", round((k * 37 % 11) / 10, 2)) for k in range(600)]
    scored = spark.createDataFrame(rows, "query_id long, docid long, url string, score double")
    got = {(r.query_id, r.docid): r["rank"] for r in search.ranked(scored).collect()}
    want = {}
    for q in (1, 2):
        for n, (_, d, *_) in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1])), 1):
            want[q, d] = n
    assert got == want
    assert {k: v for k, v in want.items() if v <= 4} == {(r.query_id, r.docid): r["rank"] for r in search.ranked(scored, 4).collect()}

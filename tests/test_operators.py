import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagewright.operators import dedup, graph
from pagewright.operators.groups import components, paired
from pagewright.operators.ranking import counts_above, global_row_number, row_number_by_text, row_number_within
from pagewright.operators.skew import join_weighted
from pagewright.params import COMPAT
from pagewright.plans.materialize import materialize
from pagewright.sources import compaction, pages


def test_counts_above_with_ties(spark):
    rng = random.Random(1)
    values = [float(rng.choice([0, 0, 0, 1, rng.random()])) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for r in counts_above(df, "v").collect():
        assert r.above == sum(v > r.value for v in values) and r.ties == values.count(r.value)


def test_global_row_number(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.choice([0, rng.randrange(50)]))) for k in range(3000)]
    got = [(r.k, r["rank"]) for r in global_row_number(spark.createDataFrame(rows, "k long, s double"), "s", "k").collect()]
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert dict(got) == want and len(got) == len(rows)


def test_row_number_by_text(spark):
    names = [f"n{k * 7919 % 1000}" for k in range(1000)]
    rows = row_number_by_text(spark.createDataFrame([(n,) for n in names], "x string"), "x", "id").collect()
    assert {r.x: r.id for r in rows} == {n: k for k, n in enumerate(sorted(names), 1)}


def test_join_weighted_hot_and_cold(spark):
    rows = materialize(spark.createDataFrame([("hot", k) for k in range(500)] + [(f"c{k}", k) for k in range(500)], "key string, v int"), "rows")
    dim = rows.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    got = join_weighted(rows, dim, "key", "w", 1000, hot=10).collect()
    assert len(got) == 1000 and {r.w for r in got if r.key == "hot"} == {500}


def test_paired_in_blocks(spark):
    rows = [("g", k) for k in range(70)] + [("h", k) for k in (1, 2)] + [("i", 5)]
    got = [(r.group, r.a, r.b) for r in paired(spark.createDataFrame(rows, "group string, item long"), "group", "item", block=16).collect()]
    want = {("g", a, b) for a in range(70) for b in range(a + 1, 70)} | {("h", 1, 2)}
    assert len(got) == len(want) and set(got) == want


def test_hot_group_is_spread(spark):
    """Half of all rows in one group: every pair once, and no task with more than its part of them."""
    rows = [("hot", k) for k in range(1200)] + [(f"g{k // 2}", k) for k in range(1200)]
    pairs = paired(materialize(spark.createDataFrame(rows, "group string, item long"), "rows"), "group", "item", block=64)
    assert pairs.count() == 1200 * 1199 // 2 + 600 and pairs.distinct().count() == pairs.count()
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


def test_row_number_within_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(0 if k % 2 else k, rng.randrange(50), k) for k in range(2000)]
    got = {(r.g, r.k): r.n for r in row_number_within(spark.createDataFrame(rows, "g long, s long, k long"), "g", ["s", "k"], "n").collect()}
    want = {}
    for g, _, k in sorted(rows):
        want[g, k] = 1 + sum(1 for h, _ in want if h == g)
    assert got == want


def test_fingerprints_in_ranges_like_one_pass(spark):
    rng = random.Random(5)
    params = replace(COMPAT, window=20)
    rows = [(k * 3, rng.choice([rng.getrandbits(32), 7, 1 << 31, 255]) ^ (1 << rng.randrange(32))) for k in range(700)]
    kept, want = [], []
    for docid, fp in rows:
        if all((fp ^ f).bit_count() > 3 for f in kept[-20:]):
            kept.append(fp)
            want.append(docid)
    table = spark.createDataFrame(rows, "docid long, fp long").repartition(5)
    for ranges in (1, 4, 9):
        assert sorted(r.docid for r in dedup.by_fingerprint(table, params, ranges).collect()) == want
    assert dedup.by_fingerprint(table.limit(0), params).count() == 0


def test_hot_links(spark, monkeypatch):
    """A url with half of all links, and hot keys in the steps, give what plain joins give."""
    monkeypatch.setattr(graph, "HOT", 2)
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, f"u{k}") for k in range(60)], "docid long, url string")
    links = [(rng.randrange(60), "u1") for _ in range(400)] + [(rng.randrange(60), f"u{rng.randrange(70)}") for _ in range(400)]
    edges = materialize(graph.link_graph(spark.createDataFrame(links, "src long, dst_url string"), docs), "edges")
    assert {tuple(r) for r in edges.collect()} == {(s, int(u[1:])) for s, u in links if int(u[1:]) < 60}
    params = replace(COMPAT, iterations=6)
    got = [(r.docid, r.hub, r.auth) for hot in (2, 4096) for r in _with(monkeypatch, hot, graph.hits, edges, docs, params)]
    half = len(got) // 2
    assert sorted(got[:half]) == [(d, pytest.approx(h), pytest.approx(a)) for d, h, a in sorted(got[half:])]


def _with(monkeypatch, hot, f, edges, docs, params):
    monkeypatch.setattr(graph, "HOT", hot)
    return f(edges, docs.select("docid"), params).collect()


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.item: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


STORE = [
    '{"rec_id": 1, "url": "u", "content": "a}"}\r\n\r\n  {"content":"b","url":"v","rec_id":2} \n',
    '{"rec_id": 1, "url": "u", "content": "a\\u007d"}\n{"rec_id": 3, "url": "w", "con',
    '{"rec_id": 4, "content": "cut }',
    '{"x": 1}\nplain\n[1]\n',
    "",
    None,
]


def test_complete_records(spark):
    files = spark.createDataFrame([(c, 1) for c in STORE], "content string, n_bytes int")
    rows = compaction.unique_records(compaction.complete_records(files)).orderBy("rec_id").collect()
    assert [tuple(r) for r in rows] == [(1, "u", "a}"), (2, "v", "b")]
    assert compaction.complete_records(files.limit(0)).count() == 0


def test_consolidate_store_and_verify(spark, tmp_path):
    spark.createDataFrame([(c,) for c in STORE * 50], "content string").repartition(40).write.parquet(str(tmp_path / "store"))
    out = compaction.consolidate_store(spark, str(tmp_path / "store"), str(tmp_path / "out"))
    assert sorted(r.rec_id for r in out.collect()) == [1, 2]
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
    with pytest.raises(FileExistsError):
        compaction.consolidate_store(spark, str(tmp_path / "store"), str(tmp_path / "out"))


def test_compact_files_keeps_every_line(spark, tmp_path):
    for k in range(120):
        folder = tmp_path / "in" / f"d{k % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.txt").write_text(f"line {k}\n\nline {k % 10}\n")
    out = compaction.compact_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == 360 and len(list((tmp_path / "out").glob("*.parquet"))) == 1


def test_rewritten_store(spark):
    files = spark.createDataFrame([(c, 1) for c in STORE * 5], "content string, n_bytes int")
    got = compaction.rewritten_store(files.repartition(3)).collect()
    assert [tuple(r) for r in got] == [(30, 1, 40, 2)]
    assert compaction.rewritten_store(files.limit(0)).first().records == 0


def test_plan_splits():
    plan = compaction.plan_splits(1_000_000, 1_000_000 * 2048, 128 << 20, 64)
    assert plan.open_cost_bytes == 4096 and plan.partitions == 16 and plan.max_partition_bytes <= 128 << 20
    assert compaction.plan_splits(0, 0, 128 << 20, 8).partitions == 1


def test_scan_json_and_delivered(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "2.json").write_text('{"url": "u2", "content": "two"}')
    (tmp_path / "1.json").write_text('{"url": "u1"}')
    (tmp_path / "x.txt").write_text("no")
    rows = pages.scan_json(spark, str(tmp_path)).orderBy("docid").collect()
    assert [(r.docid, r.url, r.content) for r in rows] == [(1, "u1", ""), (2, "u2", "two")]
    table = spark.createDataFrame([(1, "u", " x ", "2024-02-01"), (1, "u", "y", "2024-01-01"), (2, "v", None, None), (None, "w", "z", None)], "docid long, url string, content string, ingested_at string")
    once = pages.delivered(table)
    assert sorted((r.docid, r.content) for r in once.collect()) == [(1, "y"), (2, "")]
    assert [r.content for r in pages.clean(once).collect()] == ["y"]

"""Distinctive terms, score fusion and container filling."""

import itertools
import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import distinctive, fusion, packing

POSTINGS = "bid int, token string, docid long, tf int, important byte, z string, record int"


def postings(spark, rows):
    return spark.createDataFrame([(0, t, d, n, 0, "extra", 7) for t, d, n in rows], POSTINGS)


def test_z_scores_like_the_formula(spark):
    rng = random.Random(5)
    rows = list({(f"t{rng.randrange(12)}", rng.randrange(20)): rng.randrange(1, 9) for _ in range(150)}.items())
    rows = [(t, d, n) for (t, d), n in rows]
    got = {(r.record, r.term): r for r in distinctive.distinctive_terms(postings(spark, rows + rows[:20])).collect()}
    total = sum(n for *_, n in rows)
    docs = {d for _, d, _ in rows}
    a0 = total / len(docs)
    for t, d, n in rows:
        whole = sum(x for u, _, x in rows if u == t)
        size = sum(x for _, e, x in rows if e == d)
        a = whole * a0 / total
        y, r = n + a, whole - n + a
        z = (math.log(y / (size + a0 - y)) - math.log(r / (total - size + a0 - r))) / math.sqrt(1 / y + 1 / r)
        assert got[d, t].z == pytest.approx(z) and got[d, t].n == size and got[d, t].records == len(docs)
    assert len(got) == len(rows)


def test_invalid_counts_do_not_matter(spark):
    rows = [("a", 1, 5), ("b", 1, None), ("c", 1, 0), ("d", 1, -1), (None, 1, 3), ("a", None, 3), ("a", 2, 1), ("b", 2, 4)]
    got = {(r.record, r.term) for r in distinctive.distinctive_terms(postings(spark, rows)).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b")}


def test_hot_record_is_spread(spark):
    rows = [(f"t{k}", 1, 1 + k % 3) for k in range(900)] + [("t0", d, 2) for d in range(2, 400)]
    got = {(r.record, r.term): r for r in distinctive.distinctive_terms(postings(spark, rows + rows[:1] * 2000)).collect()}
    assert len(got) == len(rows) and {r.n for r in got.values() if r.record == 1} == {sum(n for _, d, n in rows if d == 1)}
    assert got[1, "t0"].df == 399 and got[2, "t0"].n == 2


def test_no_odds_and_empty_tables(spark):
    assert [r.z for r in distinctive.distinctive_terms(postings(spark, [("a", 1, 2)])).collect()] == [None]
    assert distinctive.distinctive_terms(postings(spark, [])).count() == 0 and distinctive.filling_terms(postings(spark, [])).count() == 0


def test_found_terms(spark):
    rows = [("rare", 1, 3), ("rare", 2, 3)] + [("common", d, 97) for d in range(1, 61)] + [("single", 3, 50)]
    got = {tuple(r) for r in distinctive.filling_terms(postings(spark, rows)).collect()}
    assert got == {(1, "rare"), (2, "rare")}


def test_found_terms_like_the_criterion(spark):
    """The bound on z loses no term, also where one record holds most of the counts."""
    rng = random.Random(8)
    for heavy in (1, 4000):
        rows = list({(f"t{rng.randrange(300)}", d): rng.randrange(1, 6) for d in range(120) for _ in range(rng.randrange(1, 30))}.items())
        rows = [(t, d, n * heavy if d == 0 else n) for (t, d), n in rows]
        size, df = {}, {}
        for t, d, n in rows:
            size[d] = size.get(d, 0) + n
            df[t] = df.get(t, 0) + 1
        want = {(d, t) for t, d, n in rows if n * 100 >= 3 * size[d] and 2 <= df[t] <= 12 and df[t] * 100 <= 5 * len(size)}
        scored = distinctive.distinctive_terms(postings(spark, rows))
        assert {tuple(r) for r in distinctive.filling_terms(postings(spark, rows)).collect()} == want and want
    total, largest = sum(n for *_, n in rows), max(size.values())
    bound = distinctive.least_z(0.03, max(sum(n for u, _, n in rows if u == t) for t in df), largest, total, total / len(size))
    assert min(r.z for r in scored.collect() if r.tf * 100 >= 3 * r.n and r.df > 1) >= bound - 1e-9


SCORES = ["p", "q"]


def items(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "id long, p float, q float, rank double, score string")


def test_standings_and_ranking_like_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, -1.0, 0.0, 0.0, float(rng.randrange(30)), float("nan"), 1e9]), rng.random()) for k in range(400)]
    got = {r.id: r for r in fusion.score_standings(items(spark, rows + rows[:50] + [(None, 1.0, 1.0)]), "id", SCORES).collect()}
    usable = lambda v: -1.0 if v is None or v != v or v < 0 else v
    for k, p, _ in rows:
        mine = usable(p)
        above, ties = sum(usable(x) > mine for _, x, _ in rows), sum(usable(x) == mine for _, x, _ in rows)
        assert got[k].p_above == above and got[k].p_pct == pytest.approx((400 - above - ties / 2) / 400) and got[k].p_valid == (mine >= 0)
    assert len(got) == 400
    ranked = fusion.fused_ranking(items(spark, rows), "id", SCORES).collect()
    normal = statistics.NormalDist().inv_cdf
    want = {k: round((normal(got[k].p_pct) + normal(got[k].q_pct)) / 2, 6) for k, *_ in rows}
    assert {r.id: round(r.score, 6) for r in ranked} == pytest.approx(want, abs=2e-6)
    order = sorted(ranked, key=lambda r: (-r.score, r.id))
    assert [r["rank"] for r in order] == list(range(1, 401))


def test_scale_does_not_matter_and_edges(spark):
    rows = [(k, float(k % 7), float(k * 31 % 11)) for k in range(60)]
    blown = [(k, p, q * 1e6) for k, p, q in rows]
    plain, scaled = (sorted((r["rank"], r.id) for r in fusion.fused_ranking(items(spark, x), "id", SCORES).collect()) for x in (rows, blown))
    assert plain == scaled
    assert fusion.score_standings(items(spark, []), "id", SCORES).count() == 0
    assert [r.score for r in fusion.fused_ranking(items(spark, [(1, None, None)]), "id", SCORES).collect()] == [0.0]
    with pytest.raises(ValueError):
        fusion.fused_ranking(items(spark, rows), "id", SCORES, [1.0])


def test_best_by_all(spark):
    rows = [(k, float(k), float(k)) for k in range(40)] + [(99, 100.0, None)]
    best = fusion.best_by_all(fusion.score_standings(items(spark, rows), "id", SCORES), "id", SCORES)
    assert sorted(r.id for r in best.collect()) == [36, 37, 38, 39]


def test_best_by_all_with_ties_like_the_criterion(spark):
    rng = random.Random(9)
    for kinds in (3, 400):
        rows = [(k, float(rng.randrange(kinds)), rng.choice([None, float(rng.randrange(kinds))])) for k in range(300)]
        best = fusion.best_by_all(fusion.score_standings(items(spark, rows), "id", SCORES), "id", SCORES)
        few = lambda i, v: v is not None and sum((r[i] or -1) > v for r in rows) * 10 < len(rows)
        assert sorted(r.id for r in best.collect()) == [r[0] for r in rows if few(1, r[1]) and few(2, r[2])]


def brute_fill(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    return max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), max_size=7), st.integers(0, 40))
def test_best_fill_is_optimal(counts, room):
    chosen = packing.best_fill(counts, sorted(counts, reverse=True), room)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == brute_fill(counts, room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_pack_lengths_uses_everything_once(lengths):
    counts = {k: len(list(g)) for k, g in itertools.groupby(sorted(lengths))}
    used: dict[int, int] = {}
    for pattern, times in packing.pack_lengths(counts, 50):
        assert sum(k * n for k, n in pattern.items()) <= 50
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def test_pack(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0, None, rng.randrange(1, 3000), 2048, 5000]), "x") for k in range(500)]
    got = packing.pack(spark.createDataFrame(rows + rows[:9] + [(None, 5, "x")], "doc_id long, tokens int, container string")).collect()
    fill, size = {}, {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.tokens
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert size == {k: n or 0 for k, n, _ in rows} and max(fill.values()) <= 2048
    assert {r.doc_id for r in got if r.pieces > 1} == {k for k, n, _ in rows if (n or 0) > 2048}
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int")).count() == 0

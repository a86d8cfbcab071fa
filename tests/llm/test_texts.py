"""Near-duplicates, shared spans and corpus encoding, against brute force."""

import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import encoding, neardup, spans
from pagewright.llm.fmindex import FMIndex

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ra ne ti so vu pa".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("broadcast_rows", [neardup.BROADCAST_ROWS, 0])
def test_near_duplicates_like_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = text(rng, 120)
        rows += [(len(rows) + j, edited(rng, base, e)) for j, e in enumerate([0, 0, 1, 4, 12, 25][: rng.randrange(1, 7)])]
    rows += [(900, None), (901, ""), (902, "two words"), (903, rows[0][1].upper()), (904, "lone " * 3), (905, text(rng, 20_000))]
    table = spark.createDataFrame([(k, "extra", t) for k, t in rows] + [(0, "again", rows[0][1]), (None, "x", rows[0][1])], "docid long, cls string, content string")
    members, links = neardup.near_duplicates(table, width=3, threshold=0.5, html=False)
    got = {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows if t and len(w := re.findall(r"\w+", t.lower())) >= 3}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == want and len(want) > 60
    groups = {r.docid: r.grp for r in neardup.duplicate_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and len(set(groups.values())) > 30


@pytest.mark.parametrize("hot", [neardup.HOT, 40])
def test_versions_inside_a_template_are_all_found(spark, monkeypatch, hot):
    """Half of all texts share a frame, dense nodes in every tree; among them are texts with many versions."""
    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(14)
    frame = text(rng, 40)
    rows = [(k, frame + " " + text(rng, 70)) for k in range(150)]
    for k in range(3):
        base = text(rng, 90)
        rows += [(1000 + 100 * k + j, frame + " " + edited(rng, base, 7)) for j in range(30)]
    rows += [(2000 + k, text(rng, 100)) for k in range(150)]
    table = spark.createDataFrame(rows, "docid long, content string")
    members, links = neardup.near_duplicates(table, width=3, threshold=0.5, html=False)
    got = {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows if (w := t.split())}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.997 * len(want) > 1000


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "docid long, content string"))
    assert members.count() == 0 and neardup.all_pairs(members, links).count() == 0 and neardup.duplicate_groups(members, links).count() == 0


def test_prefixes_shorten_to_the_recall():
    assert neardup.prefix_depth(0.8, 96, 0.997, 8) == 8
    assert neardup.prefix_depth(0.5, 96, 0.997, 8) == 4
    with pytest.raises(ValueError):
        neardup.prefix_depth(0.1, 4, 0.999, 8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é𝒳", min_size=1, max_size=30), min_size=1, max_size=6, unique=True), st.integers(1, 9))
def test_matching_statistics_like_brute_force(texts, span):
    index = FMIndex(texts, span)
    which, offset, interval = index.matching_statistics(texts)
    by_interval: dict[int, set] = {}
    seen = {}
    for w, o, i in zip(which.tolist(), offset.tolist(), interval.tolist(), strict=True):
        by_interval.setdefault(i, set()).add(texts[w][o : o + span])
        seen[w, o] = i
    places = {(w, o) for w, t in enumerate(texts) for o in range(len(t) - span + 1)}
    assert set(seen) == places
    assert all(len(strings) == 1 for strings in by_interval.values())
    strings = {}
    for (w, o), i in seen.items():
        assert strings.setdefault(texts[w][o : o + span], i) == i


def brute_spans(rows, span):
    places = {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            places.setdefault(t[i : i + span], {}).setdefault(k, []).append(i)
    pairs, covered = set(), {}
    for held in places.values():
        keys = sorted(held)
        pairs |= {(a, b) for a in keys for b in keys if a < b}
        if len(keys) > 1:
            for k in keys:
                covered.setdefault(k, set()).update(x for i in held[k] for x in range(i, i + span))
    return pairs, {k: len(v) for k, v in covered.items()}


@pytest.mark.parametrize(("block", "broadcast_rows"), [(4096, 500_000), (3, 0)])
def test_shared_spans_like_brute_force(spark, monkeypatch, block, broadcast_rows):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(9)
    bits = [text(rng, 12) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(bits) if rng.random() < 0.35 else text(rng, 9) for _ in range(rng.randrange(1, 6)))) for k in range(60)]
    rows += [(70, rows[0][1]), (71, None), (72, ""), (73, "x" * 500), (74, "x" * 45), (75, "é𝒳" * 40), (76, "z" + "é𝒳" * 30), (77, text(rng, 4000))]
    table = spark.createDataFrame([(k, "extra", t) for k, t in rows] + [(0, "x", rows[0][1]), (None, "x", rows[0][1])], "doc_id long, cls string, text string")
    members, intervals, sets = spans.shared_spans(table, span=40)
    pairs, covered = brute_spans(rows, 40)
    assert {tuple(r) for r in spans.sharing_pairs(members, sets).collect()} == pairs and pairs
    shares = {r.doc_id: r.shared_chars for r in spans.shared_shares(members, intervals).collect()}
    assert shares == {k: covered.get(k, 0) for k, t in rows if t and len(t) >= 40}
    groups = {r.doc_id: r for r in spans.sharing_groups(members, sets).collect()}
    text_of = dict(rows)
    for k in groups:
        linked = {text_of[b if a == k else a] for a, b in pairs if k in (a, b)} - {text_of[k]}
        assert groups[k].links == len(linked) and all(groups[a].grp == groups[b].grp for a, b in pairs if k in (a, b))


def test_passage_that_half_of_all_documents_have(spark, monkeypatch):
    """A hot region stands once; repeated passages inside one document are not shared."""
    monkeypatch.setattr(spans, "HOT", 8)
    rng = random.Random(15)
    passage, own = text(rng, 30), text(rng, 20)
    rows = [(k, text(rng, 10) + " " + (passage if k % 2 else text(rng, 30)) + " " + text(rng, 10)) for k in range(80)] + [(90, own + " " + own + " " + own)]
    members, intervals, sets = spans.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), span=60)
    pairs, covered = brute_spans(rows, 60)
    assert {tuple(r) for r in spans.sharing_pairs(members, sets).collect()} == pairs and len(pairs) >= 780
    shares = {r.doc_id: r.shared_chars for r in spans.shared_shares(members, intervals).collect()}
    assert shares == {k: covered.get(k, 0) for k, _ in rows}


def test_index_is_small():
    rng = random.Random(16)
    texts = [text(rng, 300) for _ in range(40)]
    assert FMIndex(texts, 200).size() < 1.6 * sum(map(len, texts))


def test_shared_spans_of_nothing(spark):
    members, intervals, sets = spans.shared_spans(spark.createDataFrame([], "doc_id long, text string"))
    assert spans.sharing_pairs(members, sets).count() == 0 and spans.shared_shares(members, intervals).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(encoding.BYTE_BPE), reason="no vocabulary file")
ODD = ["", None, " ", "\n\n \t x", "<|endoftext|> a<|endoftext|>", "日本語" * 200, "​  é́", "a" * 9000, "don't we'll 'tis", "🧪" * 300, "1234567890 " * 90]


@needs_vocabulary
@pytest.mark.parametrize("broadcast_bytes", [encoding.BROADCAST_BYTES, -1])
def test_encoding_is_exact(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(encoding, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(10)
    shared = [text(rng, 300), "it's  odd;\n\n" * 80, "日本語テキスト" * 100]
    rows = [(k, rng.choice(["", " ", "x"]).join([text(rng, rng.randrange(40)), rng.choice(shared), text(rng, rng.randrange(40))])) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(ODD)] + [(200, rows[0][1]), (None, rows[1][1]), (3, rows[3][1])]
    table = spark.createDataFrame([(k, "ids", t) for k, t in rows], "doc_id long, ids string, text string")
    got = encoding.encode_corpus(table).collect()
    encoder, _ = encoding.tokenizer()
    want = sorted((k if k is not None else -1, encoder.encode_ordinary(t) if t else []) for k, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got) == want
    assert encoding.encode_corpus(table.limit(0)).count() == 0
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(table).collect()}
    assert counts[100] == counts[101] == 0 and None not in counts


@needs_vocabulary
@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "\n", "é", "'s", "12", "  ", "!?", "日", "x y"]), max_size=60), st.data())
def test_splicing_any_cut_is_exact(parts, data):
    encoder, widths = encoding.tokenizer()
    whole = "".join(parts)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), max_size=6)))
    known = [(a, b, np.array(encoder.encode_ordinary(whole[a:b]), dtype=np.int32)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    assert encoding.encode_spliced(whole, known, encoder, widths) == encoder.encode_ordinary(whole)


def test_chunks_cover_texts_and_follow_content():
    rng = random.Random(11)
    base = text(rng, 900)
    ends = encoding.chunk_ends(base)
    assert ends[-1] == len(base) and ends == sorted(set(ends)) and encoding.chunk_ends("") == []
    moved = encoding.chunk_ends("some words before " + base)
    assert len({e + 18 for e in ends} & set(moved)) > 0.7 * len(ends)
    assert max(b - a for a, b in zip([0, *encoding.chunk_ends("q" * 30_000)], encoding.chunk_ends("q" * 30_000), strict=False)) <= encoding.MOST

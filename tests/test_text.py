import urllib.parse
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import hashing, rules, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_follow_the_treebank_rules(spark):
    got = one(spark, "Good muffins cost $3.88 in New York. I cannot, don't \"quote\" (a--b) 'tis it...", text.tokens)
    want = "good muffins cost $ 3.88 in new york. i can not , do n't \" quote \" ( a -- b ) 't is it ...".split()
    assert got == want


def test_empty_and_blank_texts_have_no_tokens(spark):
    assert one(spark, "", text.tokens) == [] and one(spark, " \n  ", text.tokens) == []
    assert one(spark, None, text.tokens) is None


def test_bigrams_are_raw_slices(spark):
    df = spark.createDataFrame([("a  b, c",), ("a",), ("",)], "x string")
    got = [r.ngrams for r in text.with_ngrams(df, "x", 2).collect()]
    assert got == [["a  b", "b,", ", c"], [], []]
    with pytest.raises(ValueError):
        text.with_ngrams(df, "x", 0)
    assert text.with_ngrams(df, "x", 3).first().ngrams == ["a  b,", "b, c"]


def test_stems(spark):
    pairs = "this thi was wa because becaus once onc caresses caress ponies poni hopping hop falling fall relational relat flies fli dying die skies sky c++ c++ a a".split()
    words = spark.createDataFrame([(w,) for w in pairs[::2]], "word string").distinct()
    got = {r.word: r.token for r in text.stemmed(words, "word", "token").collect()}
    assert got == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_stopwords_are_the_known_set():
    assert len(rules.STOPWORDS) == 174 and "the" in rules.STOPWORDS and "will" not in rules.STOPWORDS


def test_html_text_glues_cells_and_hides_scripts(spark):
    page = "<td>a</td><td>b</td><script>x('</p>')</script><!-- c --><style>d</style> F&uuml;r &lt;x&gt; &amp;amp;"
    assert one(spark, page, text.html_text) == "ab Für <x> &amp;"


def test_links_in_bold_are_lost_unless_kept(spark):
    page = '<b><a href="/x">x</a></b><a class="k" href=\'/y\'>y</a>'
    assert one(spark, page, text.hrefs) == ["/y"]
    assert one(spark, page, lambda c: text.hrefs(c, keep_important=True)) == ["/x", "/y"]


BASES = ["http://a.example/b/c/d.html?q#f", "https://h.test", "http://a.example/b/"]
HREFS = ["", "x.html", "/y/z", "//o.test/p", "?k=v", "#g", "../u", "./v/./w", "../../t", "http://q.example/r#s", "mailto:m@n"]


def test_resolved_like_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS if h]
    df = spark.createDataFrame(rows, "b string, h string")
    got = {(r.b, r.h): r.u for r in df.select("b", "h", text.resolved(F.col("b"), F.col("h")).alias("u")).collect()}
    for b, h in rows:
        want = urllib.parse.urljoin(b, h)
        if "../" not in h or urllib.parse.urlparse(b).path.count("/") > 2:
            assert got[b, h] == want, (b, h)


def test_crc_check_values(spark):
    df = spark.createDataFrame([("123456789",), ("graph",), ("tree",)], "w string")
    got = {r.w: r.c & (1 << 64) - 1 for r in df.select("w", hashing.crc64(F.col("w")).alias("c")).collect()}
    assert got["123456789"] == 0x995DC9BBDF1939FA
    assert got["graph"] & 0xFFFFFFFF == 0xA3DEA225 and got["tree"] & 0xFFFFFFFF == 0x67F2C32D
    crc, size = spark.createDataFrame([("Hello é",)], "w string").select(*hashing.exact_hash(F.col("w"))).first()
    assert (crc, size) == (1911885418, 8) == (zlib.crc32("Hello é".encode()), 8)


def bag(spark, words):
    df = spark.createDataFrame([(1, w, n) for w, n in words.items()], "docid long, word string, tf int")
    df = df.withColumn("low", hashing.crc64(F.col("word")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return hashing.simhash(df).first()["fp"]


def test_simhash_golden(spark):
    assert f"{bag(spark, {'graph': 2, 'tree': 1, 'node': 1}):032b}" == "00100011110111101010001000100101"
    assert f"{bag(spark, {'graph': 2, 'tree': 1, 'edge': 1}):032b}" == "00100011110111101000001000100101"
    assert f"{bag(spark, {'a': 1, 'b': 1}):032b}" == "00000100000000000000000000000001"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcxyz.,!' ", min_size=0, max_size=40), min_size=1, max_size=5))
def test_tokens_do_not_depend_on_white_space_around(spark, parts):
    df = spark.createDataFrame([(p,) for p in parts], "x string")
    rows = df.select(text.tokens(F.col("x")).alias("a"), text.tokens(F.concat(F.lit(" \n"), F.col("x"))).alias("b")).collect()
    quoteless = [r for r, p in zip(rows, parts, strict=True) if "'" not in p]
    assert all(r.a == r.b for r in quoteless)


def test_any_number_of_dot_segments(spark):
    bases = ["http://h.test/a/b/c/d/e/f/g.html", "http://h.test", "http://h.test/x/?q=/../y"]
    hrefs = ["../" * k + end for k in range(9) for end in ("", "z", "z/./y", "z/../..", ".")] + ["/a/../../b", "/./..", "a/b/../c?x=../y", "..", "//n.test/a/../b", "a//../b"]
    rows = [(b, h) for b in bases for h in hrefs if h]
    got = {(r.b, r.h): r.u for r in spark.createDataFrame(rows, "b string, h string").select("b", "h", text.resolved(F.col("b"), F.col("h")).alias("u")).collect()}
    assert got == {(b, h): urllib.parse.urljoin(b, h) for b, h in rows}


def test_flat_ngrams(spark):
    rows = spark.createDataFrame([(1, "One two, three"), (2, "x"), (3, "")], "k int, t string")
    got = {r.k: r.f for r in text.with_flat_ngrams(rows, "t", 3, "f").collect()}
    assert got == {1: ["one", "two", ",", "three", "one two", "two,", ", three", "one two,", "two, three"], 2: ["x"], 3: []}

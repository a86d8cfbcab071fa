import json

from pyspark.sql import functions as F

from pagewright import cli
from pagewright.functions.html_parser import parse, parsed
from pagewright.operators import incremental, index
from pagewright.streaming.ingest import arrivals, index_stream

SUBJECTS = "graph tree garden bridge river copper violin winter".split()


def rows():
    out = []
    for k in range(1, 25):
        s = SUBJECTS[k % 8]
        body = " ".join(f"{s}{i} {SUBJECTS[(k + i) % 8]}{i * k}" for i in range(25))
        out.append((k, f"http://h.test/{k}", f"<p>{body}</p><a href='/{k % 5 + 1}'>x</a>"))
    out += [(25, "http://h.test/3", "<p>new text at an old address</p>"), (26, "http://h.test/26", out[4][2]), (27, "http://h.test/27", out[6][2].replace("0 ", "0 zz ", 1))]
    return out


def whole(spark, data):
    return index.build(spark.createDataFrame(data, "docid long, url string, content string"))


def same(a, b):
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(a.docinfo, "docid", "total_tokens", "url") == key(b.docinfo, "docid", "total_tokens", "url")
    assert key(a.postings, "bid", "token", "docid", "tf") == key(b.postings, "bid", "token", "docid", "tf")
    assert key(a.doclinks, "src", "dst_url") == key(b.doclinks, "src", "dst_url")


def test_batches_give_the_index_of_one_build(spark, tmp_path):
    data, folder = rows(), str(tmp_path / "ix")
    frame = lambda some: spark.createDataFrame(some, "docid long, url string, content string")
    incremental.append(frame(data[:10]), folder, 0)
    assert incremental.last_docid(spark, folder) == 10
    incremental.append(frame(data[:20]), folder, 1)
    incremental.append(frame(data), folder, 2)
    same(incremental.load(spark, folder), whole(spark, data))


def test_stream_resumes(spark, tmp_path):
    data, source, folder = rows(), tmp_path / "in", str(tmp_path / "ix")
    source.mkdir()
    for part in (data[:15], data[15:]):
        spark.createDataFrame(part, "docid long, url string, content string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("docid long, url string, content string").parquet(str(source))
        query = index_stream(stream, folder, str(tmp_path / "check"))
        query.awaitTermination(120)
        assert query.exception() is None
    same(incremental.load(spark, folder), whole(spark, data))


def test_arrivals(spark):
    table = spark.createDataFrame([("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 2), ("2024-01-03 00:00:00", 1), (None, 3)], "t string, site_id int")
    got = arrivals(table.withColumn("fetched_at", F.to_timestamp("t"))).orderBy("start").collect()
    assert [(r.rows, r.sites) for r in got] == [(2, 2), (1, 1)]


def test_parser(spark):
    page = "<title>T &amp; U</title><b>bold <a href='../x#f'>l</a></b><script>no</script><p>end"
    text, links, important = parse(page, "http://h.test/a/b")
    assert text == "T & Ubold lend" and links == ["http://h.test/x"] and important == [(1, "T & U"), (6, "bold  l")]
    assert parse(None, None) == ("", [], []) and parse("a<br>b", "", " ")[0] == "a b"
    df = spark.createDataFrame([(page, "http://h.test/a/b"), (None, None)], "p string, u string")
    got = [r.x for r in df.select(parsed(F.col("p"), F.col("u")).alias("x")).collect()]
    assert got[0].text == "T & Ubold lend" and got[0].important[0].rank == 1 and got[1].text == ""


def _lines(lines):
    def read(_):
        for line in lines:
            return line
        raise EOFError

    return read


def test_cli(spark, tmp_path, capsys, monkeypatch):
    folder = tmp_path / "pages"
    folder.mkdir()
    for k, (_, url, content) in enumerate(rows()[:6]):
        (folder / f"{k}.json").write_text(json.dumps({"url": url, "content": content}))
    cli.main(["index", str(folder), str(tmp_path / "ix")])
    cli.main(["rank", str(tmp_path / "ix")])
    cli.main(["search", str(tmp_path / "ix"), "garden1"])
    assert "Rank 1: http://h.test/" in capsys.readouterr().out
    asked = iter(["", "garden1", "nosuchwordanywhere"])
    monkeypatch.setattr("builtins.input", _lines(asked))
    cli.main(["search", str(tmp_path / "ix")])
    out = capsys.readouterr().out
    assert out.count("Number of results:") == 2 and "Number of results: 0" in out and "Query time:" in out
    cli.main(["stats", str(tmp_path / "ix")])
    out = capsys.readouterr().out
    assert "Number of documents: 6 (0 empty, 6 not)" in out and "KB" in out
    assert spark.read.parquet(str(tmp_path / "ix" / "docinfo.ranked")).count() == 6

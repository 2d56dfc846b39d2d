import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import extract, incremental, ingest, stats
from textloom.sources import api, files
from textloom.streaming.ingest import LANDED, StoreStream

STORE = "url string, raw_html string, source string, crawl_time long, content_hash string"


def test_upsert(spark):
    store = spark.createDataFrame([("a", "x", "s", 1, "h1"), ("b", "x", "s", 1, None)], STORE)
    batch = spark.createDataFrame([("a", "y", "t", 2, "h2"), ("b", "x", "t", 2, None), ("c", "z", "t", 2, "h3")], STORE)
    got = {r.url: (r.raw_html, r.source, r.crawl_time, r.action) for r in ingest.upsert(store, batch).collect()}
    assert got == {"a": ("y", "s", 2, "update"), "b": ("x", "s", 1, "keep"), "c": ("z", "t", 2, "insert")}
    assert {r.url for r in ingest.not_stored(batch, store).collect()} == {"c"}
    assert ingest.bulk_insert(store, batch.union(batch), ["crawl_time"]).count() == 3


def test_quota(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], 7) for i in range(20)], "id int, source string, _n int")
    got = ingest.quota(d, "source", ["id"], {"a": 3}).collect()
    assert sorted(r.id for r in got) == [0, 2, 4]
    already = spark.createDataFrame([("a", 2)], "source string, already long")
    assert [r.id for r in ingest.quota(d, "source", ["id"], {"a": 3}, already).collect()] == [0]


def test_records(spark):
    a = {"pmcid": "P1", "title": "T", "abstractText": "x" * 100, "authorList": {"author": [{"firstName": "A", "lastName": "B"}, {"lastName": "C"}]}, "keywordList": {"keyword": [{"keyword": "k"}, "l"]}}
    df = spark.createDataFrame([(json.dumps(a),), (json.dumps({"pmcid": "", "abstractText": "x" * 200}),), (json.dumps({"pmcid": "P2", "abstractText": "short"}),), ("{}",)], "value string")
    r = df.select(F.from_json("value", ingest.ARTICLE).alias("r"))
    got = ingest.articles(r, "https://X.org/", F.lit(5)).collect()
    assert len(got) == 1 and got[0].url == "https://x.org/P1"
    assert "<p class='authors'>A B,  C</p>" in got[0].raw_html and "<p class='keywords'>k; l</p>" in got[0].raw_html
    t = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "Brief"}, "designModule": {"phases": ["P1", "P2"]}, "descriptionModule": {"briefSummary": "s" * 300}}}
    r = spark.createDataFrame([(json.dumps(t),)], "value string").select(F.from_json("value", ingest.TRIAL).alias("r"))
    page = ingest.trials(r, "https://x.org/", F.lit(5)).first().raw_html
    assert "<title>Brief</title>" in page and "<p class='phases'>P1, P2</p>" in page


HTML = [
    ("<title> T </title><body>no<article><h1>A</h1><p>b &amp; c</p><!-- no --></article></body>", "T", "Ab & c"),
    ("<div id='main-content'>x\n\n  y  z</div><p>no</p>", "", "x\ny z"),
    ("<body><div role='main'>m</div>no</body>", "", "m"),
    ("<body><p>a<p>b<script>s</script></body>", "", "abs"),
    ("just text", "", "just text"),
    ("", "", ""),
]


@pytest.mark.parametrize("page, title, body", HTML)
def test_page_text(page, title, body):
    assert extract.page_text(page) == (title, body)


def test_corpus_files(spark, tmp_path):
    raw = spark.createDataFrame([("u2", "<title>a\tb</title><body>é text</body>"), ("u1", "<body>x</body>"), ("u3", None), ("u4", "<body> </body>")], "url string, raw_html string")
    c = extract.corpus(raw, ["url"])
    assert [(r.doc_id, r.url, r.text_size_bytes) for r in c.orderBy("doc_id").collect()] == [(0, "u1", 1), (1, "u2", 7)]
    files.write_corpus(c, str(tmp_path / "corpus"))
    files.write_manifest(extract.manifest(c), str(tmp_path / "manifest"))
    m = files.read_manifest(spark, str(tmp_path / "manifest"))
    assert {(r.doc_id, r.title) for r in m.collect()} == {(0, None), (1, "a b")} or {(r.doc_id, r.title) for r in m.collect()} == {(0, ""), (1, "a b")}
    got = {r.doc_id: (r.title, r.url, r.body) for r in files.indexed_files(m, files.read_corpus(spark, str(tmp_path / "corpus"))).collect()}
    assert got == {0: ("", "u1", "x\n"), 1: ("a b", "u2", "é text\n")}
    assert extract.export_counts(raw).first() == (2, 2)


def test_api_pages(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"resultList": {"result": [{"pmcid": "1"}, {"pmcid": "2"}]}, "nextCursorMark": "B"}))
    (tmp_path / "B.json").write_text(json.dumps({"resultList": {"result": [{"pmcid": "3"}]}, "nextCursorMark": "B"}))
    api.register(spark)
    df = spark.read.format("paged_records").option("path", str(tmp_path)).option("service", "literature").load()
    assert [json.loads(r.value)["pmcid"] for r in df.collect()] == ["1", "2", "3"]
    assert len(list(api.follow(str(tmp_path), "literature", quota=2))) == 2


def test_changed_pages(spark):
    from datetime import datetime

    at = datetime(2025, 1, 1)
    raw = spark.createDataFrame(
        [(1, "http://A/x/", "b1", 10, "H1 ", at), (2, "http://a/x", "b2", 11_000_000_000_000, "h2", at), (3, "http://a/y", "b", None, "", at), (4, "http://a/z", "b", 5, "h4", at), (5, None, "b", 5, "h", at), (6, "http://a/n", None, None, None, at)],
        "raw_id long, url string, raw_html string, crawl_time long, content_hash string, landed_at timestamp",
    )
    state = spark.createDataFrame([("http://a/x", "h2", 1), ("http://a/x", "h1", 2), ("http://a/x", "h2", 3), ("http://a/z/", " H4", 2)], "url string, content_hash string, run_id int")
    runs = spark.createDataFrame([(1, "succeeded"), (2, "succeeded"), (3, "failed")], "run_id int, status string")
    got = {r.url: r.content_hash for r in incremental.changed_pages(raw, state, runs).collect()}
    assert got == {"http://a/x": "h2", "http://a/y": "92eb5ffee6ae2fec3ad71c777531578f", "http://a/n": None}
    assert incremental.changed_pages(raw.limit(0), state, runs).count() == 0
    assert incremental.changed_pages(raw, state.limit(0), runs.limit(0)).count() == 4


def test_file_batches_survive_failure(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("one")
    b = incremental.FileBatches(spark, root)
    read = lambda paths: spark.read.text(paths)

    def broken(paths):
        raise OSError("lost")

    with pytest.raises(OSError):
        b.run(str(source), broken, batch_id="1")
    assert b.output() is None
    assert b.run(str(source), read, batch_id="1") == "1" and b.run(str(source), read, batch_id="1") is None
    assert b.run(str(source), read) is None
    (source / "b.txt").write_text("two")
    (source / "a.txt").write_text("three")
    assert b.run(str(source), read, batch_id="2") == "2"
    assert sorted(r.value for r in b.output().collect()) == ["one", "three", "two"]


def test_file_that_returns_to_an_earlier_version(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    b = incremental.FileBatches(spark, str(tmp_path / "out"))
    for batch, text in (("1", "one"), ("2", "two"), ("3", "one")):
        (source / "a.txt").write_text(text)
        assert b.run(str(source), lambda paths: spark.read.text(paths), batch_id=batch) == batch
    assert b.run(str(source), lambda paths: spark.read.text(paths)) is None


def test_stream(spark, tmp_path):
    rows = [("http://A/x", "b1", "s", 1, None), ("http://a/x/", "b2", "s", 2, None), ("http://a/y", "b", "s", 1, None)]
    spark.createDataFrame(rows, LANDED).write.parquet(str(tmp_path / "in"))
    s = StoreStream(spark, str(tmp_path / "store"))
    s.start(str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("http://a/y", "new", "t", 5, None)], LANDED).write.mode("append").parquet(str(tmp_path / "in"))
    s.start(str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.url, r.raw_html, r.source) for r in s.current().collect()} == {("http://a/x", "b2", "s"), ("http://a/y", "new", "s")}


def test_statistics(spark):
    f = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50)], "term string, freq long")
    r = stats.ranked(f)
    assert [tuple(x) for x in r.orderBy("rank").collect()] == [(1, "a", 100, 100.0), (2, "b", 50, 50.0), (3, "c", 50, pytest.approx(100 / 3))]
    fit = stats.zipf_fit(stats.ranked(stats.synthetic_frequencies(spark, 2000))).first()
    assert 0.9 < fit.alpha < 1.2
    assert stats.corpus_stats(spark.createDataFrame([], "n long, text string"), "n", "text").first().num_documents == 0

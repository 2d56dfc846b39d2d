import json

import pytest
from pyspark.sql import functions as F

from textloom import pipeline
from textloom.operators import incremental
from textloom.operators.index import Index, decoded_postings, stored_index
from textloom.sources import config, files
from textloom.streaming.ingest import LANDED, StoreStream


def page(service, keys, following=None):
    if service == "literature":
        body = {"resultList": {"result": [{"pmcid": k, "title": f"About {k}", "abstractText": "liver therapy " * 10} for k in keys]}}
        return json.dumps(body | ({"nextCursorMark": following} if following else {}))
    studies = [{"protocolSection": {"identificationModule": {"nctId": k, "briefTitle": k}, "descriptionModule": {"briefSummary": "skin " * 80}}} for k in keys]
    return json.dumps({"studies": studies} | ({"nextPageToken": following} if following else {}))


@pytest.fixture
def landing(tmp_path):
    for service, first, second in (("literature", ["A1", "A2", ""], ["A3", "A1"]), ("trials", ["N1"], ["N2"])):
        d = tmp_path / "landing" / service
        d.mkdir(parents=True)
        (d / "first.json").write_text(page(service, first, "B"))
        (d / "B.json").write_text(page(service, second))
    return str(tmp_path / "landing")


def test_from_pages_to_results(spark, tmp_path, landing):
    settings = config.Config(store=str(tmp_path / "store"), targets={"literature": 2, "trials": 7})
    assert pipeline.run_ingest(spark, settings, landing, at=9) == {"literature": 2, "trials": 2}
    assert pipeline.run_ingest(spark, settings, landing, at=9) == {"literature": 0, "trials": 0}
    raw = spark.read.parquet(f"{settings.store}/documents")
    assert {r.url.rsplit("/", 1)[1] for r in raw.collect()} == {"A1", "A2", "N1", "N2"}
    assert pipeline.export_corpus(raw, str(tmp_path / "corpus")).first() == (4, 0)
    report = pipeline.build_index(spark, str(tmp_path / "corpus"), str(tmp_path / "index"), compress=True).first()
    assert report.num_docs == 4 and report.bytes > 0 and report.saved is not None
    index = Index.open(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, decoded_postings(index.coded()).collect())) == sorted(map(tuple, index.postings.select("term", "doc_id", "tf").collect()))
    lines = pipeline.search_lines(spark, str(tmp_path / "index"), ["liver therapy", " ", "skin !liver"]).collect()
    assert {(r.query_id, r.line.split("\t")[2]) for r in lines} == {(1, "About A1"), (1, "About A2"), (2, "N1"), (2, "N2")}
    assert pipeline.corpus_report(spark, str(tmp_path / "corpus")).first().num_documents == 4


def test_unreadable_and_short_files(spark, tmp_path):
    (tmp_path / "0.txt").write_text("  T\x1f \r\nu\r\nbody\r\nmore")
    (tmp_path / "1.txt").write_text("only\none")
    (tmp_path / "x.txt").write_text("t\nu\nb")
    (tmp_path / "2.txt").write_text("é" * 600 + "\n" + "v" * 3000 + "\nb")
    (tmp_path / "manifest.tsv").write_text("doc_id\turl\ttitle\ttext_size_bytes\n0\tu\tT\t4\n2\tv\tE\t1\n7\tw\tgone\t1\n")
    got = {r.doc_id: r for r in files.read_corpus(spark, f"{tmp_path}/*.txt").collect()}
    assert set(got) == {0, 2} and (got[0].title, got[0].url, got[0].body) == ("T", "u", "body\r\nmore")
    assert files.read_corpus(spark, f"{tmp_path}/*.txt", numbered=False).count() == 3
    cut = {r.doc_id: r for r in files.indexed_files(files.read_manifest(spark, str(tmp_path / "manifest.tsv")), files.read_corpus(spark, f"{tmp_path}/*.txt")).collect()}
    assert set(cut) == {0, 2}
    from textloom.functions.text import first_bytes

    t = spark.createDataFrame([("é" * 600,), ("ab",), (None,)], "t string").select(first_bytes(F.col("t"), 1023).alias("t")).collect()
    assert [r.t for r in t] == ["é" * 511, "ab", None]


def test_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    built = []

    def build():
        built.append(1)
        return Index.of(spark.read.parquet(str(tmp_path / "docs")))

    a = stored_index(spark, str(tmp_path / "docs"), build)
    assert stored_index(spark, str(tmp_path / "docs"), build) is a and len(built) == 1 and a.num_docs == 2
    docs.limit(1).write.mode("append").parquet(str(tmp_path / "docs"))
    b = stored_index(spark, str(tmp_path / "docs"), build)
    assert len(built) == 2 and b.path != a.path
    plan = a.postings.where(F.col("term").isin("aa"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [aa])]" in plan or "EqualTo(term,aa)" in plan
    a.close()
    with pytest.raises(Exception):
        Index.open(spark, a.path)


def test_sql_functions(spark):
    pipeline.register_functions(spark)
    r = spark.sql("SELECT tl_tokens('Dose-dependent p53 1'), tl_stem('therapies'), tl_normalize_url('HTTP://A.org/X/?q'), tl_format_size(1152), tl_tfidf(5, 100, 1000, 10), tl_query_terms('liver !skin'), tl_vbyte_size(128)").first()
    assert list(r)[:4] == [["dose", "dependent", "p53"], "therapi", "http://a.org/X", "1.12 KB"]
    assert r[4] == pytest.approx(0.05 * 4.605170186) and r[5] == ["liver", "skin"] and r[6] == 2


def batch_rows(spark):
    return lambda paths: spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))


def test_newest_version_of_each_file(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    b = incremental.FileBatches(spark, str(tmp_path / "out"))
    transform = batch_rows(spark)

    def run(batch):
        return b.run(str(source), transform, batch_id=batch)

    def shown():
        return sorted(r.value for r in b.current().collect())

    (source / "a.txt").write_text("one")
    (source / "b.txt").write_text("b")
    assert run("1") == "1" and shown() == ["b", "one"]
    (source / "a.txt").write_text("two")
    assert run("2") == "2" and shown() == ["b", "two"]
    (source / "a.txt").write_text("one")
    assert run("3") == "3" and shown() == ["b", "one"]
    (source / "b.txt").unlink()
    assert run("4") == "4" and shown() == ["one"]
    (source / "a.txt").touch()
    assert run("5") is None and shown() == ["one"] and run("6") is None
    (source / "b.txt").write_text("b")
    assert run("7") == "7" and shown() == ["b", "one"]


@pytest.mark.parametrize("step", ["write", "commit"])
def test_crash_at_each_step(spark, tmp_path, monkeypatch, step):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(str(i))
    b = incremental.FileBatches(spark, str(tmp_path / "out"))
    transform = batch_rows(spark)
    with pytest.raises(OSError), monkeypatch.context() as m:

        def lost(*_):
            raise OSError("lost")

        if step == "commit":
            m.setattr(incremental, "publish", lost)
        b.run(str(source), lost if step == "write" else transform, batch_id="1")
    assert b.current() is None
    assert b.run(str(source), transform, batch_id="2", most=2) == "2"
    assert b.run(str(source), transform, batch_id="3", most=2) == "3"
    assert b.run(str(source), transform) is None
    assert sorted(r.value for r in b.current().collect()) == ["0", "1", "2"]


def test_store_goes_on_after_a_new_checkpoint(spark, tmp_path):
    s = StoreStream(spark, str(tmp_path / "store"))
    for k, (land, check, rows) in enumerate([("in", "cp", [("http://a/x", "1", "s", 1, None)]), ("in", "cp", [("http://a/x", "2", "t", 2, None)]), ("in2", "cp2", [("http://a/y", "3", "s", 1, None)])]):
        spark.createDataFrame(rows, LANDED).write.mode("append").parquet(str(tmp_path / land))
        s.start(str(tmp_path / land), str(tmp_path / check)).awaitTermination()
        assert len(s._changes()) == k + 1
    want = {("http://a/x", "2", "s"), ("http://a/y", "3", "s")}
    assert {(r.url, r.raw_html, r.source) for r in s.current().collect()} == want
    b = spark.createDataFrame([("http://a/x", "9", "s", 9, None)], LANDED)
    s.apply(b, 7)
    s.apply(b, 7)
    assert len(s._changes()) == 4
    s.compact()
    assert len(s._changes()) == 1
    s.apply(b, 7)
    assert len(s._changes()) == 1
    assert {(r.url, r.raw_html) for r in s.current().collect()} == {("http://a/x", "9"), ("http://a/y", "3")}


def test_clashing_columns_nulls_and_empty_tables(spark):
    from textloom.operators import extract, ingest

    schema = "url string, raw_html string, title int, body int, doc_id long"
    raw = spark.createDataFrame([("u", "<title>t</title><body>x</body>", 1, 2, 9), ("v", None, 1, 2, 9), (None, "y", 1, 2, 9)], schema)
    assert [(r.doc_id, r.url, r.title, r.body) for r in extract.corpus(raw, ["url"]).orderBy("doc_id").collect()] == [(0, None, "", "y"), (1, "u", "t", "x")]
    assert extract.corpus(raw.limit(0), ["url"]).count() == 0
    docs = spark.createDataFrame([(1, "aa", "p", 3, 1), (2, None, None, None, None), (3, "", "q", 1, 1)], "doc_id long, text string, term string, tf int, df int")
    index = Index.of(docs)
    assert [tuple(r) for r in index.postings.select("term", "doc_id", "tf").collect()] == [("aa", 1, 1)]
    assert index.meta.first().num_docs == 3
    empty = spark.createDataFrame([], "r struct<pmcid:string>, n long")
    assert ingest.stored_by_source(spark.createDataFrame([(None,)], "url string"), {"s": ["x"]}).first() == ("s", 0)
    assert empty.count() == 0

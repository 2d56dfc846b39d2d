import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators.index import _merge_blocks, decoded_postings, encoded_postings, encoded_texts, postings
from textloom.queries import QUERIES


def test_blocks_of_texts(spark):
    texts = [(5, "Trials, trial-trials of X9 12 7 a ÀB\u2028 12\u2028"), (70_000, "trial"), (5, "a trial"), (6, None), (7, " 12 "), (3 << 40, "trial  liver"), ((1 << 53) + 1, "liver"), (200_005, "of\x1cx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    blocks = encoded_texts(docs)
    assert sorted(map(tuple, decoded_postings(blocks).collect())) == sorted(
        [("trial", 5, 4), ("of", 5, 1), ("x9", 5, 1), ("Àb\u2028", 5, 1), ("12\u2028", 5, 1), ("trial", 70_000, 1), ("trial", 3 << 40, 1), ("liver", 3 << 40, 1), ("liver", (1 << 53) + 1, 1), ("of\x1cx", 200_005, 1)]
    )
    assert {r.block: (r.n, bytes(r.code)) for r in blocks.where("term = 'trial'").collect()} == {0: (1, b"\x05\x04"), 1: (1, bytes([0xF0, 0x22, 1])), 3 << 24: (1, b"\x00\x01")}
    assert "trials" in {r.term for r in encoded_texts(docs, stemming=False).collect()}


def test_blocks_of_texts_are_those_of_their_postings(spark):
    docs = spark.range(0, 150_000, 7).select(F.col("id").alias("doc_id"), F.expr("concat('Tests testing w', id % 1000, repeat(' many', int(id % 400)))").alias("text")).repartition(5)
    want = {(r.term, r.block): (r.n, bytes(r.code)) for r in encoded_postings(postings(docs)).collect()}
    assert {(r.term, r.block): (r.n, bytes(r.code)) for r in encoded_texts(docs).collect()} == want


@pytest.mark.parametrize("name", ["vbyte_blocks", "vbyte_roundtrip"])
def test_no_word_is_stemmed_at_each_occurrence(spark, tmp_path, name):
    spark.createDataFrame([(1, "tests")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan and "Join" not in plan


def test_parts_of_a_block_in_several_batches():
    def batch(*rows):
        return pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(dict(term=pa.string(), block=pa.int64(), n=pa.int32(), code=pa.binary()).items())})

    got = list(_merge_blocks(iter([batch(("a", 0, 1, b"\x05\x01")), batch(), batch(("a", 0, 2, b"\x03\x02\x01\x01"), ("a", 1, 1, b"\x00\x01"), ("b", 1, 1, b"\x09\x01"))])))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [("a", 0, 2, b"\x03\x02\x01\x02"), ("a", 1, 1, b"\x00\x01"), ("b", 1, 1, b"\x09\x01")]


def test_words_of_long_texts():
    t = "Ab ab-cd  " * 50
    assert text.word_counts_py(t.encode(), 7) == text.word_counts_py(t.encode()) == {b"ab": 100, b"cd": 50}

import math
import random

import pytest

from textloom.operators import search
from textloom.operators.index import Index, decoded_postings, encoded_postings, posting_deltas
from textloom.plans import query as q

DOCS = {1: "aa", 2: "bb", 3: "cc", 4: "aa bb", 5: "aa cc", 6: "bb cc", 7: "aa bb cc", 8: ""}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame([(k, v, 0) for k, v in DOCS.items()] + [(9, None, 0)], "doc_id long, text string, tf int")
    from pyspark.sql import functions as F

    return Index.of(df, F.concat(F.lit("T"), "doc_id"), F.lit("u")).write(str(tmp_path_factory.mktemp("index")))


CASES = {
    "!aa": set(), "aa || !bb": {1, 4, 5, 7}, "!aa !bb cc": set(), "cc !aa !bb": {3}, "aa !!bb": {1, 4, 5, 7}, "(!aa) bb": {2, 6},
    "aa !(bb !cc)": {1, 5, 7}, "aa &&": set(), "|| aa": {1, 4, 5, 7}, "aa ||": {1, 4, 5, 7}, "()": set(), ") aa": set(), "aa ) bb": {1, 4, 5, 7},
    "(aa": {1, 4, 5, 7}, "aa & bb": {4, 7}, "": set(), "AA": {1, 4, 5, 7}, "zz aa": set(), "zz || aa": {1, 4, 5, 7}, "(aa || bb) cc": {5, 6, 7},
}


@pytest.mark.parametrize("text", CASES)
def test_boolean(index, text):
    sets = {t: {d for d, body in DOCS.items() if t in body.split()} for t in ("aa", "bb", "cc")}
    assert q.matches(q.parse(text), sets) == CASES[text]
    assert {r.doc_id for r in search.scored(index, text).collect()} == CASES[text]
    assert {r.doc_id for r in search.joined(index, text).collect()} == CASES[text]


def test_parser():
    t = q.Term
    assert q.parse("breast cancer") == q.And(t("breast"), t("cancer")) == q.parse("breast && cancer")
    assert q.parse("breast || lung") == q.Or(t("breast"), t("lung"))
    assert q.parse("!benign") == q.Not(t("benign")) and q.parse("") is None and q.parse(None) is None
    assert q.parse("(breast || lung) cancer") == q.And(q.Or(t("breast"), t("lung")), t("cancer"))
    assert q.terms(q.parse("running (a || !b) run"), positive_only=True) == ["run", "a"]


def test_random_trees_agree():
    rng = random.Random(1)
    sets = {t: {d for d in range(40) if rng.random() < 0.4} for t in "abcd"}
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c", "d", " ", " ", "!", "(", ")", " && ", " || "]) for _ in range(rng.randint(1, 14)))
        got = q.matches(q.parse(text), sets)
        assert got <= set().union(*(sets.get(t, set()) for t in q.terms(q.parse(text), positive_only=True)))


def test_scores_and_pages(index):
    n = len(DOCS) + 1
    got = search.search(index, "aa bb").collect()
    want = {4: 0.5 * math.log(n / 4) * 2, 7: 2 / 3 * math.log(n / 4)}
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [4, 7]
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id]) and r.title == f"T{r.doc_id}" and r.total_matched == 2
    whole = [r.doc_id for r in sorted(search.search(index, "aa || bb", 0, 100).collect(), key=lambda r: r["rank"])]
    paged = [r.doc_id for p in (1, 2, 3) for r in sorted(search.search_page(index, "aa || bb", p, 2).collect(), key=lambda r: r["rank"])]
    assert paged == whole and len(whole) == 6
    assert [r.doc_id for r in search.search_page(index, "aa || bb", 99, 4).orderBy("rank").collect()] == whole[4:]
    assert search.search_page(index, "  ").count() == 0
    many = search.search_many(index, {1: "aa bb", 2: "cc !aa", 3: "", 4: "zz"}).collect()
    assert {(r.query_id, r.doc_id) for r in many} == {(1, 4), (1, 7), (2, 3), (2, 6)}
    assert search.cli_lines(search.search(index, "aa bb")).orderBy("rank").first().line == f"4\t{want[4]:.6f}\tT4\tu"


def test_index(index):
    m = index.meta.first()
    assert (m.num_docs, m.num_terms, m.num_postings) == (9, 3, 12)
    p = index.postings.select("term", "doc_id", "tf")
    assert sorted(map(tuple, decoded_postings(encoded_postings(p)).collect())) == sorted(map(tuple, p.collect()))
    assert {(r.term, r.doc_id): r.delta for r in posting_deltas(p).collect() if r.term == "aa"} == {("aa", 1): 1, ("aa", 4): 3, ("aa", 5): 1, ("aa", 7): 2}


def test_empty_collection(spark):
    i = Index.of(spark.createDataFrame([], "doc_id long, text string"))
    assert search.search(i, "aa").count() == 0 and i.meta.first().num_docs == 0

import random
from collections import defaultdict
from datetime import datetime

import pytest

from textloom.llm import terms

TOKENS = "doc_id long, position int, text string, record int, term int"


def test_counts_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        for p in range(rng.randint(0, 60)):
            w = rng.choice(["a", "A ", "b\u00a0", "e\u0301", "\u00c9", "zz", "", "  ", None, "hot", "hot", "hot"])
            rows.append((d, p, w, 1, 2))
            if rng.random() < 0.2:
                rows.append((d, p, w, 1, 2))
    rows += [(None, 1, "x", 0, 0), (3, None, "x", 0, 0), (50, 70000, "far", 0, 0), (50, 3, "far", 0, 0), (50, 140000, "near", 0, 0), (50, 70000, "far", 0, 0)]
    truth = defaultdict(list)
    for d, p, w in {(d, p, w) for d, p, w, _, _ in rows if d is not None and p is not None and w and w.strip()}:
        import unicodedata

        truth[unicodedata.normalize("NFC", w.strip().lower())].append(d)
    df = spark.createDataFrame(rows, TOKENS)
    got = terms.term_counters(terms.token_rows(df)).collect()
    total = [r.records for r in got if r.term is None]
    assert {r.term: (r.occurrences, r.records) for r in got if r.term} == {t: (len(ds), len(set(ds))) for t, ds in truth.items()}
    assert total == [len({d for ds in truth.values() for d in ds})]


def test_counters_flush_at_a_small_vocabulary():
    import pyarrow as pa

    rows = [(d, p, f"w{(d * 7 + p) % 11}", 1, False) for d in range(30) for p in range(5)]
    cols = list(zip(*rows, strict=True))
    batch = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4])], names=["record", "slot", "term", "n", "long"])
    batches = [batch.slice(i, 13) for i in range(0, len(rows), 13)]

    def total(limit):
        out = defaultdict(lambda: [0, 0])
        for b in terms._last_seen(iter(batches), limit=limit):
            for r in b.to_pylist():
                out[r["term"]][0] += r["occurrences"]
                out[r["term"]][1] += r["records"]
        return dict(out)

    assert total(3) == total(10**6)
    assert total(3)[None][1] == 30


P = "term string, doc_id long, tf int, loaded_at timestamp, record int"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def test_newest_posting_decides(spark):
    rows = [("a", 1, 5, T0, 0), ("A ", 1, 2, T1, 0), ("a", 2, 3, T1, 0), ("a", 2, 7, T1, 0), ("b", 1, 4, T0, 0), ("b", 1, None, T1, 0), ("c", 1, 1, None, 0), ("c", 1, 9, T0, 0), (None, 1, 1, T0, 0), ("d", 1, 0, T0, 0)]
    got = {(r.term, r.record): r.tf for r in terms.counted_postings(spark.createDataFrame(rows, P)).collect()}
    assert got == {("a", 1): 2, ("a", 2): 7, ("c", 1): 9}


def test_marks(spark):
    rows = [(d, i, w, 0, 0) for d in range(10) for i, w in enumerate(["the", f"only{d}"] + (["some"] * 3 if d < 3 else []))]
    df = spark.createDataFrame(rows, TOKENS)
    got = {r.term: r.mark for r in terms.term_frequency({"token": (terms.token_rows(df), True)}).collect()}
    assert got["the"] == "common" and got["only3"] == "rare" and got["some"] is None


def test_empty(spark):
    assert terms.term_frequency({"token": (terms.token_rows(spark.createDataFrame([], TOKENS)), True), "posting": (terms.posting_rows(spark.createDataFrame([], P)), False)}).count() == 0


def test_weight_and_candidates(spark):
    rng = random.Random(5)
    rows = [(f"t{min(int(rng.paretovariate(0.7)), 60)}", d, rng.randint(1, 4), T0, 0) for d in range(60) for _ in range(12)]
    rows = list({(t, d): (t, d, f, at, x) for t, d, f, at, x in rows}.values())
    p = spark.createDataFrame(rows, P)
    f = spark.createDataFrame([(d, None if d % 3 else 40, T0) for d in range(50)], "doc_id long, doc_total_tokens int, loaded_at timestamp")
    h = spark.createDataFrame([(0, 10, T0), (0, 60, T1), (1, 5, T0)], "segment_id int, num_docs int, built_at timestamp")
    s = terms.distinctiveness(p, f, h)
    got = {(r.record, r.term): (r.weight, r.ppmi) for r in s.collect()}
    import math

    total, df = defaultdict(int), defaultdict(int)
    for t, d, tf, *_ in rows:
        total[d] += tf
        df[t] += 1
    assert len(got) == len(rows)
    for t, d, tf, *_ in rows:
        length = 40 if d < 50 and d % 3 == 0 else total[d]
        assert got[d, t][0] == pytest.approx(tf / length * math.log(65 / df[t]))
        cf, mass = sum(f for x, _, f, *_ in rows if x == t), sum(v**0.75 for v in total.values())
        every = sum(total.values())
        pmi = math.log((tf / every) / (cf / every * total[d] ** 0.75 / mass))
        assert got[d, t][1] == pytest.approx(max(pmi, 0.0), abs=1e-12)
    for least in (0.05, 0.12, 0.5):
        kept = {(r.record, r.term) for r in terms.distinctive_terms(s, least).collect()}
        assert kept == {k for k, (w, _) in got.items() if w >= least}


@pytest.mark.parametrize("long_record", [1 << 16, 5])
def test_posting_counters(spark, monkeypatch, long_record):
    monkeypatch.setattr(terms, "LONG_RECORD", long_record)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "A", "b", "c", "d", None, ""]), rng.randrange(30), rng.choice([None, 0, 1, 2, 5]), rng.choice([T0, T1, None]), 0) for _ in range(400)]
    newest = {}
    for t, d, tf, at, _ in rows:
        if t:
            key = (t.lower(), d)
            newest[key] = max(newest.get(key, ((False, T0), -1)), ((at is not None, at or T0), max(tf or 0, 0)))
    truth = defaultdict(list)
    for (t, d), (_, tf) in newest.items():
        if tf >= 1:
            truth[t].append((d, tf))
    got = terms.term_counters(terms.posting_rows(spark.createDataFrame(rows, P))).collect()
    assert {r.term: (r.occurrences, r.records) for r in got if r.term} == {t: (sum(f for _, f in x), len(x)) for t, x in truth.items()}
    assert [r.records for r in got if r.term is None] == [len({d for x in truth.values() for d, _ in x})]

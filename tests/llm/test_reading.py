from textloom.llm import reading

PLAIN, GENERAL, EXPERT = "take the pill and rest today ", "the study found that patients recovered sooner ", "histochemical cytometry delineated translocation "


def test_levels(spark):
    docs = [(i, t * 12, lang, 0) for i, (t, lang) in enumerate([(PLAIN, "en"), (GENERAL, "EN"), (EXPERT, "en-US"), (PLAIN, "eng"), (GENERAL, "English"), (EXPERT, "en_GB"), (PLAIN, "de"), (PLAIN, None)])]
    docs += [(20, "short text", "en", 0), (21, None, "en", 0), (22, "", "en", 0), (23, "9 " * 80, "en", 0), (24, EXPERT * 40000, "en", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, reading_level int")
    labels = spark.createDataFrame([(0, "plain"), (1, "general"), (2, "expert"), (2, "expert"), (2, "plain"), (5, "plain"), (5, "expert"), (1, None), (4, "odd")], "doc_id long, reading_level string")
    got = {r.doc_id: r.reading_level for r in reading.english_levels(d, labels).collect()}
    assert {k: got[k] for k in range(6) if k in got} == {0: "plain", 1: "general", 3: "plain", 4: "general"} | {k: "expert" for k in (2, 5) if k in got}
    assert got[24] == "expert" and 23 in got and not {6, 7, 20, 21, 22} & set(got)
    assert reading.english_levels(d, labels.limit(0)).count() == 0
    assert reading.english_levels(d.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, "x y") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "plain") for i in range(50)], "doc_id long, reading_level string")
    assert len(reading.labelled_texts(d, labels, most=20)) == 20

import pytest
from pyspark.sql import functions as F

from textloom.functions import codec, porter, text, urls

STEMS = dict(
    cancer="cancer", tumors="tumor", treatments="treatment", diagnosed="diagnos", running="run", happily="happili", generalization="gener",
    troubles="troubl", motional="motion", rational="ration", chemotherapy="chemotherapi", metastasis="metastasi", carcinogenic="carcinogen",
    progression="progress", mutations="mutat", therapeutic="therapeut", inhibitors="inhibitor", radiation="radiat", oncological="oncolog",
    cancerous="cancer", agreed="agre", feed="feed", hopping="hop", falling="fall", filing="file", sky="sky", by="by", controll="control",
)


def test_stems(spark):
    assert {w: porter.stem(w) for w in STEMS} == STEMS
    assert porter.stem("a" * 511) == "a" * 511
    df = spark.createDataFrame([(w, 1) for w in STEMS] + [(None, 2)], "token string, term int").drop("term")
    got = {r.token: r.term for r in porter.add_stem(df, "token", "term").collect()}
    assert got == {**STEMS, None: None}


def test_stem_sql_is_the_same_rules():
    duckdb = pytest.importorskip("duckdb")
    import random

    rng = random.Random(2)
    ends = [*porter.STEP2, *porter.STEP3, *porter.STEP4, "ed", "ing", "eed", "sses", "ies", "y", "ll", "e"]
    words = sorted({"".join(rng.choice("aeioubcdlstyzwé1") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)})
    con = duckdb.connect()
    con.execute("CREATE TABLE w(token VARCHAR)")
    con.executemany("INSERT INTO w VALUES (?)", [(w,) for w in words])
    got = dict(con.execute(f"WITH {porter.stem_sql('SELECT token FROM w')} SELECT token, term FROM stems").fetchall())
    assert {w: got[w] for w in words if got[w] != porter.stem(w)} == {}


TOKENS = [
    ("cancer treatment", ["cancer", "treatment"], [0, 1]),
    ("BRCA1 mutation", ["brca1", "mutation"], [0, 1]),
    ("dose-dependent therapy", ["dose", "dependent", "therapy"], [0, 1, 2]),
    ("a it is", ["it", "is"], [1, 2]),
    ("a--bb", ["bb"], [2]),
    ("-xx", ["xx"], [1]),
    (" - yy", ["yy"], [1]),
    ("ab- cd", ["ab", "cd"], [0, 1]),
    ("p53 53", ["p53"], [0]),
    ("a_b x|y", ["a_b", "x|y"], [0, 1]),
    ("é ÀB", ["é", "Àb"], [0, 1]),
    ("", [], []),
    (None, [], []),
]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TOKENS)], "i int, text string")
    for r in df.select("i", text.tokens(df.text).alias("t"), text.token_positions(df.text).alias("p")).collect():
        assert r.t == TOKENS[r.i][1]
        assert [x.text for x in r.p] == TOKENS[r.i][1] and [x.position for x in r.p] == TOKENS[r.i][2]


def test_codec(spark):
    values = [0, 127, 128, 16383, 16384, 4294967295]
    assert [len(codec.encode_values([v])) for v in values] == [1, 1, 2, 2, 3, 5]
    assert codec.decode_values(codec.encode_values(values)).tolist() == values
    assert codec.encode_values([300]) == bytes([0xAC, 0x02]) and codec.encode_values([]) == b"" and codec.decode_values(b"").tolist() == []
    df = spark.createDataFrame([([10, 20, 35, 100, 1000],), ([],), (None,)], "v array<long>")
    rows = df.select("v", codec.undo_deltas(codec.vbyte_decode(codec.vbyte_encode(codec.deltas(df.v)))).alias("w")).collect()
    assert all(r.v == r.w for r in rows)


def test_urls(spark):
    cases = {
        "HTTPS://Ex.Org/Path///?a=1#b": "https://ex.org/Path",
        "http://a.b:80/x;p?q": "http://a.b:80/x",
        "http://a.b": "http://a.b",
        "": "",
    }
    from urllib.parse import urlparse, urlunparse

    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = {r[0]: r[1] for r in df.select("url", urls.normalize_url(df.url)).collect()}
    assert got == {**cases, None: None}
    for u, n in cases.items():
        p = urlparse(u)
        assert urlunparse((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/"), "", "", "")) == n


def test_small_functions(spark):
    df = spark.createDataFrame([("42", 5), (" -7x", 2048), ("x", 3 * 1048576)], "s string, b long")
    got = df.select(text.lenient_int(df.s).alias("i"), text.format_size(df.b).alias("f")).collect()
    assert [(r.i, r.f) for r in got] == [(42, "5 B"), (-7, "2.00 KB"), (0, "3.00 MB")]
    assert spark.range(1).select(text.clean_lines(F.lit(" a  b \n\n \t\nc"))).first()[0] == "a b\nc"


def test_murmur3():
    from textloom.functions.hashing import murmur3_32

    fox = b"The quick brown fox jumps over the lazy dog"
    assert [murmur3_32(b"", 0), murmur3_32(b"", 1), murmur3_32(b"hello", 0), murmur3_32(b"hello, world", 0), murmur3_32(fox, 0)] == [0, 0x514E28B7, 0x248BFA47, 0x149BBB7F, 0x2E4FF723]

"""Queries of the core operators, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codec, hashing, porter, text, urls
from textloom import pipeline
from textloom.operators import extract, incremental, index, ingest, search, stats
from textloom.session import checkpoint_dir, read, spread
from textloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": incremental.p3_found, "p3_files": incremental.p3_files}
SQL: dict[str, str] = {"p3_found": incremental.P3_SQL, "p3_files": incremental.P3_FILES_SQL}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL ---

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = text.SEPARATORS.replace("'", "''")
_SEPH = text.SEPARATORS_AND_HYPHEN.replace("'", "''")
_LOW = f"translate(text, '{_AZ}', '{_az}')"
_VALID = "octet_length(encode({0})) >= 2 AND NOT regexp_matches({0}, '^[0-9]+$')"
_TOK = f"""tok AS (SELECT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex({_LOW}, '{_SEPH}')) AS token
  FROM documents WHERE text IS NOT NULL) WHERE {_VALID.format("token")})"""
_COUNTS = _TOK + ", cnt AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL)"
_PLAIN = _COUNTS + ", p AS (SELECT token AS term, doc_id, n AS tf FROM cnt)"
_STEMMED = _COUNTS + ",\n" + porter.stem_sql("SELECT token FROM cnt") + ",\np AS (SELECT term, doc_id, CAST(sum(n) AS BIGINT) AS tf FROM cnt JOIN stems USING (token) GROUP BY ALL)"
_SCORED = (
    _STEMMED
    + """, len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT term, doc_id, tf, tf / CAST(len AS DOUBLE) * ln(n / CAST(df AS DOUBLE)) AS w FROM p JOIN len USING (doc_id) JOIN df USING (term), n)"""
)


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return read(spark, base, "documents")


def _texts(spark: SparkSession, base: str) -> DataFrame:
    """The documents for stages that are bound by the CPU."""
    return spread(_docs(spark, base))


def _index(spark: SparkSession, base: str, anew: bool = False) -> index.Index:
    """The index of the documents, built by the first query that needs it and opened by the others."""
    return index.stored_index(spark, f"{base}/documents.parquet", lambda: index.Index.of(_texts(spark, base), F.col("source"), F.col("url")), anew=anew)


# --- tokenizer and stemmer ---


@query(f"WITH {_TOK} SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL")
def tokenize(spark, base):
    return index.token_counts(_texts(spark, base)).withColumnRenamed("tf", "n")


@query(f"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '{_SEP}'), lambda x: x <> '') AS c FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, flatten(list_transform(c, lambda x: CASE WHEN string_split(x, '-')[-1] = '' THEN string_split(x, '-')[1:-2] ELSE string_split(x, '-') END)) AS f FROM c),
u AS (SELECT doc_id, unnest(f) AS token, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS position FROM f)
SELECT doc_id, position, token FROM u WHERE {_VALID.format("token")}""")
def token_positions(spark, base):
    return index.positioned(_texts(spark, base))


@query(f"WITH {_TOK} SELECT count(*) AS num_tokens, CAST(sum(length(token)) AS BIGINT) AS total_chars FROM tok")
def token_stats(spark, base):
    return stats.token_stats(index.token_rows(_texts(spark, base)))


@query(f"SELECT doc_id, {_LOW} AS low FROM documents")
def ascii_lower(spark, base):
    return _docs(spark, base).select("doc_id", text.ascii_lower(F.col("text")).alias("low"))


@query(f"WITH {_TOK}, {porter.stem_sql('SELECT token FROM tok')} SELECT token, term FROM stems")
def porter_vocab(spark, base):
    return index.vocabulary(index.token_rows(_texts(spark, base)))


_BYTE = "CAST('0x' || substr(hx, CAST(2 * {0} + 1 AS INTEGER), 2) AS UBIGINT)"
_M32 = "4294967296::UBIGINT"


def _rot(x: str, r: int) -> str:
    return f"(({x} * {1 << r}::UBIGINT) % {_M32} + {x} // {1 << 32 - r}::UBIGINT)"


def _mix(k: str) -> str:
    a = f"({k} * 3432918353::UBIGINT % {_M32})"
    return f"({_rot(a, 15)} * 461845907::UBIGINT % {_M32})"


def _end(h: str, shift: int, factor: int) -> str:
    return f"(xor({h}, {h} // {1 << shift}::UBIGINT) * {factor}::UBIGINT % {_M32})"


@query(f"""WITH {_TOK}, w AS (SELECT DISTINCT token FROM tok), x AS (SELECT token, lower(hex(encode(token))) AS hx, octet_length(encode(token)) AS n FROM w),
k AS (SELECT token, n, list_transform(range(0, n // 4), lambda i: {" + ".join(f"{_BYTE.format(f'(4 * i + {j})')} * {256**j}::UBIGINT" for j in range(4))}) AS ks,
 list_sum(list_transform(range(n // 4 * 4, n), lambda i: CAST({_BYTE.format("i")} * power(256, i % 4) AS UBIGINT))) AS tail FROM x),
a AS (SELECT token, n, list_reduce(list_prepend(42::UBIGINT, list_transform(ks, lambda k: CAST({_mix("k")} AS UBIGINT))), lambda h, m: CAST(({_rot("xor(h, m)", 13)} * 5 + 3864292196::UBIGINT) % {_M32} AS UBIGINT)) AS h, CAST(coalesce(tail, 0) AS UBIGINT) AS t FROM k),
b AS (SELECT token, xor(xor(h, CASE WHEN n % 4 = 0 THEN 0::UBIGINT ELSE CAST({_mix("t")} AS UBIGINT) END), CAST(n AS UBIGINT)) AS h FROM a),
c AS (SELECT token, {_end("h", 16, 0x85EBCA6B)} AS h FROM b), d AS (SELECT token, {_end("h", 13, 0xC2B2AE35)} AS h FROM c)
SELECT token, CAST({_end("h", 16, 1)} AS BIGINT) AS hash FROM d""")
def term_hash(spark, base):
    """The hash by which a dictionary finds a word, of every distinct one."""
    return index.token_rows(_texts(spark, base)).select("token").distinct().select("token", hashing.murmur3(F.col("token")).alias("hash"))


@query(r"SELECT doc_id, coalesce(TRY_CAST(regexp_extract(pub_year, '^[ \t\n\r]*([+-]?[0-9]+)', 1) AS INTEGER), 0) AS year FROM documents")
def lenient_int(spark, base):
    return _docs(spark, base).select("doc_id", text.lenient_int(F.col("pub_year")).alias("year"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x:
 trim(regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{B}\x{1C}-\x{1F}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def clean_lines(spark, base):
    return _docs(spark, base).select("doc_id", text.clean_lines(F.col("text")).alias("text"))


# --- index ---


@query(f"WITH {_STEMMED} SELECT term, doc_id, tf FROM p")
def term_frequency(spark, base):
    return index.postings(_texts(spark, base))


@query(f"WITH {_STEMMED} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def doc_frequency(spark, base):
    return index.term_table(index.postings(_texts(spark, base)))


@query(f"WITH {_TOK} SELECT d.doc_id, count(t.doc_id) AS total_tokens FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id")
def doc_length(spark, base):
    return index.document_lengths(_texts(spark, base))


@query(f"WITH {_TOK} SELECT d.doc_id, any_value(d.source) AS title, any_value(d.url) AS url, count(t.doc_id) AS total_tokens FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id")
def forward_index(spark, base):
    return index.forward(_texts(spark, base), F.col("source"), F.col("url"))


@query(f"WITH {_STEMMED} SELECT 2 AS version, (SELECT count(*) FROM documents) AS num_docs, count(DISTINCT term) AS num_terms, count(*) AS num_postings, true AS stemming FROM p")
def index_stats(spark, base):
    m = index.Index.of(_texts(spark, base), F.col("source"), F.col("url")).meta
    return m.select("version", "num_docs", "num_terms", "num_postings", "stemming")


@query(f"WITH {_STEMMED} SELECT 2 AS version, (SELECT count(*) FROM documents) AS num_docs, count(DISTINCT term) AS num_terms, count(*) AS num_postings, true AS stemming FROM p")
def build_index(spark, base):
    """Builds and writes the whole index, and opens it again."""
    return _index(spark, base, anew=True).meta


@query(f"WITH {_PLAIN} SELECT term, count(*) AS df, array_to_string(list(doc_id ORDER BY doc_id), ' ') AS doc_ids, array_to_string(list(tf ORDER BY doc_id), ' ') AS tfs FROM p GROUP BY term")
def postings_list(spark, base):
    lists = index.postings_lists(index.postings(_texts(spark, base), stemming=False))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return lists.select("term", "df", join("doc_ids").alias("doc_ids"), join("tfs").alias("tfs"))


_DELTA = f"WITH {_STEMMED}, d AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS delta FROM p)"
_SIZE = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query(_DELTA + " SELECT term, doc_id, tf, delta FROM d")
def postings_delta(spark, base):
    return index.posting_deltas(index.postings(_texts(spark, base)))


@query(_DELTA + f" SELECT term, CAST(sum({_SIZE.format('delta')} + {_SIZE.format('tf')}) AS BIGINT) AS bytes FROM d GROUP BY term")
def vbyte_size(spark, base):
    d = index.posting_deltas(index.postings(_texts(spark, base)))
    return d.groupBy("term").agg(F.sum(codec.size_of(F.col("delta")) + codec.size_of(F.col("tf"))).alias("bytes"))


@query(f"WITH {_STEMMED} SELECT term, doc_id, tf FROM p")
def vbyte_roundtrip(spark, base):
    return index.decoded_postings(index.encoded_texts(_texts(spark, base)))


_CODE = "CASE " + " ".join(
    f"WHEN {{0}} < {1 << 7 * k} THEN " + " || ".join(f"printf('%02x', CAST(({{0}} // {1 << 7 * j}) % 128 + {128 if j < k - 1 else 0} AS INTEGER))" for j in range(k)) for k in range(1, 6)
) + " END"


@query(f"""WITH {_STEMMED}, b AS (SELECT term, doc_id, tf, doc_id // 65536 AS block FROM p),
d AS (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, block ORDER BY doc_id), block * 65536) AS delta FROM b)
SELECT term, block, CAST(count(*) AS INTEGER) AS n, string_agg({_CODE.format("delta")}, '' ORDER BY doc_id) || string_agg({_CODE.format("tf")}, '' ORDER BY doc_id) AS code FROM d GROUP BY term, block""")
def vbyte_blocks(spark, base):
    """The bytes of each block of a posting list, in hexadecimal."""
    blocks = index.encoded_texts(_texts(spark, base))
    return blocks.select("term", "block", "n", F.lower(F.hex("code")).alias("code"))


@query(
    _DELTA
    + f""", t AS (SELECT term, count(*) AS n, sum({_SIZE.format('delta')} + {_SIZE.format('tf')}) AS b FROM d GROUP BY term),
s AS (SELECT count(*) AS terms, sum(n) AS n, sum(b) AS b, sum(octet_length(encode(term)) + 1) AS tb FROM t),
f AS (SELECT count(*) AS docs, sum(octet_length(encode(coalesce(source, ''))) + octet_length(encode(coalesce(url, ''))) + 2) AS db FROM documents)
SELECT CAST(64 + 40 * terms + 20 * docs + tb + db + 8 * n AS BIGINT) AS plain_bytes, CAST(64 + 40 * terms + 20 * docs + tb + db + b AS BIGINT) AS coded_bytes FROM s, f"""
)
def index_size(spark, base):
    return index.index_size(index.postings(_texts(spark, base)), _docs(spark, base).select(F.col("source").alias("title"), "url"))


# --- ranking ---


@query(f"WITH {_SCORED} SELECT term, doc_id, round(tf / CAST(len AS DOUBLE), 9) AS tf FROM p JOIN len USING (doc_id)")
def tf(spark, base):
    p = _index(spark, base).postings
    return p.select("term", "doc_id", F.round(search.tf(F.col("tf"), F.col("doc_len")), 9).alias("tf"))


@query(f"WITH {_SCORED} SELECT term, round(ln(n / CAST(df AS DOUBLE)), 9) AS idf FROM df, n")
def idf(spark, base):
    i = _index(spark, base)
    return i.terms.join(F.broadcast(i.meta.select("num_docs"))).select("term", F.round(search.idf(F.col("num_docs"), F.col("df")), 9).alias("idf"))


@query(f"WITH {_SCORED} SELECT term, doc_id, round(w, 9) AS tfidf FROM w")
def tfidf(spark, base):
    i = _index(spark, base)
    p = i.postings.join(i.terms, "term").join(F.broadcast(i.meta.select("num_docs")))
    return p.select("term", "doc_id", F.round(search.tfidf(F.col("tf"), F.col("doc_len"), F.col("num_docs"), F.col("df")), 9).alias("tfidf"))


# --- boolean queries: with the tfs of the match, and without ---


def _t(*words: str) -> list[str]:
    return [f"(SELECT doc_id, tf FROM p WHERE term = '{porter.stem(w)}')" for w in words]


_LIVER, _THERAPY, _SKIN, _STUDY = _t("liver", "therapy", "skin", "study")
_WITH_TF = {
    "bool_term": ("liver", f"SELECT doc_id, tf FROM {_LIVER}"),
    "bool_and": ("liver && therapy", f"SELECT a.doc_id, a.tf + b.tf AS tf FROM {_LIVER} a JOIN {_THERAPY} b USING (doc_id)"),
    "bool_or": ("liver || skin", f"SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT * FROM {_LIVER} UNION ALL SELECT * FROM {_SKIN}) GROUP BY doc_id"),
    "bool_and_not": ("liver && !skin", f"SELECT doc_id, tf FROM {_LIVER} WHERE doc_id NOT IN (SELECT doc_id FROM {_SKIN})"),
    "bool_not_only": ("!liver", "SELECT doc_id, tf FROM p WHERE false"),
    "bool_unknown_term": ("zzzunknown liver", "SELECT doc_id, tf FROM p WHERE false"),
}
_FUSED = {
    "bool_group": ("(liver || skin) therapy", f"(SELECT doc_id FROM {_LIVER} UNION SELECT doc_id FROM {_SKIN}) INTERSECT SELECT doc_id FROM {_THERAPY}"),
    "bool_or_not": ("liver || !skin", f"SELECT doc_id FROM {_LIVER}"),
    "bool_double_not": ("liver !!skin", f"SELECT doc_id FROM {_LIVER}"),
    "bool_leading_nots": ("therapy !liver !skin", f"SELECT doc_id FROM {_THERAPY} EXCEPT SELECT doc_id FROM {_LIVER} EXCEPT SELECT doc_id FROM {_SKIN}"),
    "bool_two_nots_first": ("!liver !skin therapy", f"SELECT doc_id FROM {_THERAPY} WHERE false"),
    "bool_nested_not": ("therapy !(liver !skin)", f"SELECT doc_id FROM {_THERAPY} EXCEPT (SELECT doc_id FROM {_LIVER} EXCEPT SELECT doc_id FROM {_SKIN})"),
}


def _boolean(name: str, text_of: str, sql: str, fused: bool) -> None:
    def run(spark, base):
        i = _index(spark, base)
        return search.scored(i, text_of).select("doc_id") if fused else search.matched(i, text_of)

    QUERIES[name] = run
    SQL[name] = f"WITH {_STEMMED} {sql}"


for _name, (_q, _s) in _WITH_TF.items():
    _boolean(_name, _q, _s, fused=False)
for _name, (_q, _s) in _FUSED.items():
    _boolean(_name, _q, _s, fused=True)


# --- ranked search ---


def _ranked(where: str, terms: list[str]) -> str:
    ts = ", ".join(f"'{porter.stem(t)}'" for t in terms)
    return f"""WITH {_SCORED}, m AS ({where}),
s AS (SELECT doc_id, sum(w) AS s FROM w WHERE term IN ({ts}) AND doc_id IN (SELECT doc_id FROM m) GROUP BY doc_id),
r AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS rank, count(*) OVER () AS total_matched FROM s)"""


_AND = f"SELECT doc_id FROM {_LIVER} INTERSECT SELECT doc_id FROM {_THERAPY}"
_OR = f"SELECT doc_id FROM {_LIVER} UNION SELECT doc_id FROM {_SKIN}"
_RESULT = "SELECT rank, r.doc_id, round(s, 6) AS score, d.source AS title, d.url, total_matched FROM r JOIN documents d USING (doc_id)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"{_ranked(_AND, ['liver', 'therapy'])} {_RESULT} WHERE rank <= 50")
def search_topk(spark, base):
    return _rounded(search.search(_index(spark, base), "liver therapy"))


@query(f"{_ranked(_OR, ['liver', 'skin'])} {_RESULT} WHERE rank BETWEEN 51 AND 100")
def search_page2(spark, base):
    return _rounded(search.search_page(_index(spark, base), "liver || skin", 2))


@query(f"{_ranked(_OR, ['liver', 'skin'])} SELECT count(*) AS total_matched FROM r")
def search_total(spark, base):
    return search.scored(_index(spark, base), "liver || skin").agg(F.count("*").alias("total_matched"))


@query(f"{_ranked(_AND, ['liver', 'therapy'])} SELECT doc_id, round(s, 6) AS score FROM r")
def search_all(spark, base):
    return _rounded(search.scored(_index(spark, base), "liver therapies"))


_BATCH = {1: "liver therapy", 2: "liver || skin", 3: "study !liver", 4: ""}


@query(f"""WITH {_SCORED}, m AS (
SELECT 1 AS query_id, doc_id FROM ({_AND}) UNION ALL SELECT 2, doc_id FROM ({_OR})
UNION ALL SELECT 3, doc_id FROM (SELECT doc_id FROM {_STUDY} EXCEPT SELECT doc_id FROM {_LIVER})),
t AS (SELECT * FROM (VALUES (1, '{porter.stem('liver')}'), (1, '{porter.stem('therapy')}'), (2, '{porter.stem('liver')}'), (2, '{porter.stem('skin')}'), (3, '{porter.stem('study')}')) v(query_id, term)),
s AS (SELECT query_id, doc_id, sum(w) AS s FROM m JOIN t USING (query_id) JOIN w USING (doc_id, term) GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank, doc_id, round(s, 6) AS score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def search_batch(spark, base):
    return _rounded(search.search_many(_index(spark, base), _BATCH))


@query(f"{_ranked(_AND, ['liver', 'therapy'])} SELECT rank, printf('%d\t%.6f\t%s\t%s', r.doc_id, s, coalesce(d.source, ''), coalesce(d.url, '')) AS line FROM r JOIN documents d USING (doc_id) WHERE rank <= 50")
def cli_format(spark, base):
    return search.cli_lines(search.search(_index(spark, base), "liver therapy"))


@query(f"""{_ranked(_AND, ['liver', 'therapy'])} SELECT 1 AS query_id, rank, printf('%d\t%.6f\t%s\t%s', r.doc_id, s, coalesce(d.source, ''), coalesce(d.url, '')) AS line FROM r JOIN documents d USING (doc_id) WHERE rank <= 50""")
def search_file(spark, base):
    """Queries of a file against the index at its place."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    spark.createDataFrame([("liver therapy",), ("",), ("zzzunknown",)], "line string").coalesce(1).write.text(folder)
    return pipeline.search_lines(spark, _index(spark, base).path, folder)


# --- ingest ---

_NORM = r"""lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))
 || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')"""


@query(f"SELECT raw_id, {_NORM} AS url FROM raw_documents")
def url_normalize(spark, base):
    return read(spark, base, "raw_documents").select("raw_id", urls.normalize_url(F.col("url")).alias("url"))


@query("SELECT raw_id, md5(raw_html) AS content_hash FROM raw_documents")
def content_hash(spark, base):
    return read(spark, base, "raw_documents").select("raw_id", urls.content_hash(F.col("raw_html")).alias("content_hash"))


def _store(spark, base, late: bool) -> DataFrame:
    """Stored documents (landed before the middle of the year) or a later batch, urls normalised."""
    raw = read(spark, base, "raw_documents")
    cut = F.lit("2025-07-01").cast("timestamp")
    part = raw.where(F.col("landed_at") >= cut) if late else raw.where((F.col("landed_at") < cut) | F.col("landed_at").isNull())
    return part.select(
        urls.normalize_url(F.col("url")).alias("url"), "raw_html", "source", "crawl_time", urls.content_hash(F.col("raw_html")).alias("content_hash"), "raw_id"
    )


def _firsts(spark, base, late: bool) -> DataFrame:
    return ingest.first_by_url(_store(spark, base, late), ["raw_id"])


_PARTS = f"""raw AS (SELECT {_NORM} AS url, raw_html, source, crawl_time, md5(raw_html) AS content_hash, raw_id, landed_at FROM raw_documents),
old AS (SELECT * FROM raw WHERE landed_at < TIMESTAMP '2025-07-01' OR landed_at IS NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY raw_id) = 1),
new AS (SELECT * FROM raw WHERE landed_at >= TIMESTAMP '2025-07-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY raw_id) = 1)"""


@query(f"WITH {_PARTS} SELECT url, min(raw_id) AS raw_id FROM raw GROUP BY url")
def url_dedupe(spark, base):
    both = _store(spark, base, False).unionByName(_store(spark, base, True))
    return ingest.first_by_url(both, ["raw_id"]).select("url", "raw_id")


@query(f"WITH {_PARTS} SELECT url, coalesce(content_hash, '') AS content_hash FROM old")
def crawl_state_scan(spark, base):
    return ingest.crawl_state(_firsts(spark, base, False))


@query(f"WITH {_PARTS} SELECT url, raw_id FROM new WHERE url NOT IN (SELECT url FROM old)")
def resume_anti_join(spark, base):
    return ingest.not_stored(_firsts(spark, base, True), _firsts(spark, base, False)).select("url", "raw_id")


@query(f"WITH {_PARTS} SELECT url, raw_id FROM old UNION ALL SELECT url, raw_id FROM new WHERE url NOT IN (SELECT url FROM old)")
def bulk_insert(spark, base):
    return ingest.bulk_insert(_firsts(spark, base, False), _store(spark, base, True), ["raw_id"]).select("url", "raw_id")


@query(f"""WITH {_PARTS} SELECT url, CASE WHEN o.url IS NULL THEN n.source ELSE o.source END AS source,
CASE WHEN o.url IS NULL OR n.url IS NOT NULL AND o.content_hash IS DISTINCT FROM n.content_hash THEN n.content_hash ELSE o.content_hash END AS content_hash,
CASE WHEN o.url IS NULL THEN 'insert' WHEN n.url IS NOT NULL AND o.content_hash IS DISTINCT FROM n.content_hash THEN 'update' ELSE 'keep' END AS action
FROM old o FULL JOIN new n USING (url)""")
def upsert_changed(spark, base):
    out = ingest.upsert(_firsts(spark, base, False).drop("raw_id"), _firsts(spark, base, True).drop("raw_id"))
    return out.select("url", "source", "content_hash", "action")


_TARGETS = {"literature_api": 500, "trials_api": 100}
_PATTERNS = {"literature_api": ["papers.oncoarchive.example"], "trials_api": ["registry.trialhub.example"]}


@query("""WITH a AS (SELECT 'literature_api' AS source, count(*) FILTER (contains(url, 'papers.oncoarchive.example')) AS already FROM crawl_state
UNION ALL SELECT 'trials_api', count(*) FILTER (contains(url, 'registry.trialhub.example')) FROM crawl_state) SELECT source, already FROM a""")
def stored_by_source(spark, base):
    return ingest.stored_by_source(read(spark, base, "crawl_state"), _PATTERNS)


@query("""SELECT raw_id, source FROM raw_documents WHERE source IN ('literature_api', 'trials_api')
QUALIFY row_number() OVER (PARTITION BY source ORDER BY raw_id) <= CASE source WHEN 'literature_api' THEN 500 ELSE 100 END""")
def source_quota(spark, base):
    return ingest.quota(read(spark, base, "raw_documents"), "source", ["raw_id"], _TARGETS).select("raw_id", "source")


@query("SELECT raw_id FROM raw_documents WHERE length(raw_html) >= 1500")
def min_length_filter(spark, base):
    return read(spark, base, "raw_documents").where(F.length("raw_html") >= 1500).select("raw_id")


# --- pages ---


@query(r"SELECT raw_id, trim(regexp_extract(raw_html, '<title>([^<]*)', 1)) AS title FROM raw_documents WHERE raw_html IS NOT NULL")
def html_title(spark, base):
    raw = read(spark, base, "raw_documents").where("raw_html IS NOT NULL")
    return raw.select("raw_id", extract.title_and_body(F.col("raw_html"))["title"].alias("title"))


@query()
def html_body(spark, base):
    return extract.extracted(spread(read(spark, base, "raw_documents"))).select("raw_id", "title", "body")


@query()
def manifest(spark, base):
    return extract.manifest(extract.corpus(spread(read(spark, base, "raw_documents")), ["raw_id"]))


@query(r"""SELECT count(*) FILTER (WHERE regexp_matches(regexp_replace(coalesce(raw_html, ''), '<[^>]*>', '', 'g'), '\S')) AS exported,
count(*) FILTER (WHERE NOT regexp_matches(regexp_replace(coalesce(raw_html, ''), '<[^>]*>', '', 'g'), '\S')) AS errors FROM raw_documents""")
def export_counts(spark, base):
    return extract.export_counts(spread(read(spark, base, "raw_documents")))


@query("SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS doc_id FROM raw_documents WHERE raw_html IS NOT NULL")
def dense_ids(spark, base):
    return extract.dense_ids(read(spark, base, "raw_documents").where("raw_html IS NOT NULL").select("raw_id"), ["raw_id"])


@query(r"""SELECT doc_id, '<html><head><title>' || coalesce(source, 'Untitled') || '</title></head><body><h1>' || coalesce(source, 'Untitled') || '</h1><p class=''authors''>Ann '
|| coalesce(lang, '') || ', Bo </p><p class=''journal''>' || coalesce(journal, '') || ' (' || coalesce(pub_year, '') || ')</p><p class=''doi''></p><p class=''keywords''>cancer; '
|| coalesce(lang, 'none') || '</p><div class=''abstract''>' || text || '</div></body></html>' AS html FROM documents WHERE length(text) >= 100""")
def json_article_html(spark, base):
    """Records as the literature service sends them, made of the documents, as JSON and back."""
    d = _docs(spark, base)
    people = F.array(F.struct(F.lit("Ann").alias("firstName"), F.col("lang").alias("lastName")), F.struct(F.lit("Bo").alias("firstName"), F.lit(None).cast("string").alias("lastName")))
    words = F.array(F.lit("cancer"), F.to_json(F.struct(F.coalesce("lang", F.lit("none")).alias("keyword"))))
    record = F.struct(
        F.col("doc_id").cast("string").alias("pmcid"),
        F.col("source").alias("title"),
        F.col("text").alias("abstractText"),
        F.col("journal").alias("journalTitle"),
        F.col("pub_year").alias("pubYear"),
        F.struct(people.alias("author")).alias("authorList"),
        F.struct(words.alias("keyword")).alias("keywordList"),
    )
    r = d.select("doc_id", F.from_json(F.to_json(record), ingest.ARTICLE).alias("r"))
    return r.where(F.length("r.abstractText") >= 100).select("doc_id", ingest.article_html(F.col("r")).alias("html"))


@query(r"""SELECT doc_id, '<html><head><title>' || coalesce(journal, source, 'Untitled') || '</title></head><body><h1>' || coalesce(journal, source, 'Untitled') || '</h1><p class=''nctid''>N'
|| doc_id || '</p><p class=''status''>' || coalesce(lang, '') || '</p><p class=''phases''>PHASE1, PHASE2</p><p class=''conditions''></p><p class=''interventions''>DRUG: '
|| coalesce(source, '') || '</p><div class=''summary''>' || coalesce(text, '') || '</div><div class=''description''></div></body></html>' AS html FROM documents""")
def json_trial_html(spark, base):
    """Records as the trial service sends them, made of the documents, as JSON and back."""
    record = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("N"), "doc_id").alias("nctId"), F.col("journal").alias("officialTitle"), F.col("source").alias("briefTitle")).alias("identificationModule"),
            F.struct(F.col("text").alias("briefSummary")).alias("descriptionModule"),
            F.struct(F.col("lang").alias("overallStatus")).alias("statusModule"),
            F.struct(F.array(F.lit("PHASE1"), F.lit("PHASE2")).alias("phases")).alias("designModule"),
            F.struct(F.array(F.struct(F.lit("DRUG").alias("type"), F.col("source").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        ).alias("protocolSection")
    )
    r = _docs(spark, base).select("doc_id", F.from_json(F.to_json(record), ingest.TRIAL).alias("r"))
    return r.select("doc_id", ingest.trial_html(F.col("r")).alias("html"))


# --- entry points ---


@query(r"""WITH r AS (SELECT 'https://europepmc.org/article/PMC/' || doc_id AS url, '<html><head><title>' || coalesce(source, 'Untitled') || '</title></head><body><h1>' || coalesce(source, 'Untitled')
|| '</h1><p class=''authors''></p><p class=''journal''>' || coalesce(journal, '') || ' (' || coalesce(pub_year, '') || ')</p><p class=''doi''></p><p class=''keywords''></p><div class=''abstract''>' || text
|| '</div></body></html>' AS html FROM documents WHERE length(text) >= 100 AND source IS DISTINCT FROM 'trials_api')
SELECT url, md5(html) AS content_hash, 'literature_api' AS source FROM r""".replace("\\'", "'"))
def ingest_source(spark, base):
    """A harvest of records made of the documents, of which those of one source are stored already."""
    d = _docs(spark, base)
    none = F.lit(None).cast("string")
    r = F.struct(
        F.col("doc_id").cast("string").alias("pmcid"), F.col("source").alias("title"), F.col("text").alias("abstractText"), F.col("journal").alias("journalTitle"), F.col("pub_year").alias("pubYear"), none.alias("doi"),
        F.struct(F.array().cast("array<struct<firstName:string,lastName:string>>").alias("author")).alias("authorList"), F.struct(F.array().cast("array<string>").alias("keyword")).alias("keywordList"),
    )
    store = d.where("source = 'trials_api'").select(F.concat(F.lit(pipeline.BASE_URLS["literature"]), "doc_id").alias("url"))
    new = pipeline.ingest_source(d.select("doc_id", r.alias("r")), store, "literature", 1 << 62, F.col("doc_id"), F.lit(0))
    return new.select("url", "content_hash", "source")


@query(r"""WITH r AS (SELECT 'https://clinicaltrials.gov/study/N' || doc_id AS url, '<html><head><title>' || coalesce(journal, source, 'Untitled') || '</title></head><body><h1>' || coalesce(journal, source, 'Untitled')
|| '</h1><p class=''nctid''>N' || doc_id || '</p><p class=''status''></p><p class=''phases''></p><p class=''conditions''></p><p class=''interventions''></p><div class=''summary''>' || coalesce(text, '')
|| '</div><div class=''description''></div></body></html>' AS html FROM documents)
SELECT url, md5(html) AS content_hash FROM r WHERE length(html) >= 300""")
def ingest_trials(spark, base):
    """A harvest of trials made of the documents into an empty store."""
    none = F.lit(None)
    s = F.struct(
        F.struct(F.concat(F.lit("N"), "doc_id").alias("nctId"), F.col("journal").alias("officialTitle"), F.col("source").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("text").alias("briefSummary"), none.cast("string").alias("detailedDescription")).alias("descriptionModule"),
        F.struct(none.cast("string").alias("overallStatus")).alias("statusModule"),
        F.struct(none.cast("array<string>").alias("phases")).alias("designModule"),
        F.struct(none.cast("array<string>").alias("conditions")).alias("conditionsModule"),
        F.struct(none.cast("array<struct<type:string,name:string>>").alias("interventions")).alias("armsInterventionsModule"),
    )
    records = _docs(spark, base).select("doc_id", F.struct(s.alias("protocolSection")).alias("r"))
    new = pipeline.ingest_source(records, spark.createDataFrame([], pipeline.STORE), "trials", 1 << 62, F.col("doc_id"), F.lit(0))
    return new.select("url", "content_hash")


@query(r"""SELECT doc_id, coalesce(trim(translate(source, chr(9) || chr(10), '  ')), '') AS title, coalesce(octet_length(encode(text)), 0) + 1 AS body_bytes FROM documents""")
def corpus_files(spark, base):
    """The documents as corpus files and manifest in the shared folder, and read again as the indexer reads them."""
    d = _docs(spark, base)
    c = d.select("doc_id", "url", F.col("source").alias("title"), F.col("text").alias("body"), F.octet_length("text").alias("text_size_bytes"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    files.write_corpus(c, folder)
    files.write_manifest(extract.manifest(c), f"{folder}/manifest.tsv")
    return files.indexed_corpus(spark, folder).select("doc_id", "title", F.octet_length("body").alias("body_bytes"))


@query(f"""WITH {_COUNTS}, {porter.stem_sql("SELECT token FROM cnt")}
SELECT d.doc_id, md5(d.text) AS hash, coalesce(c.n, 0) AS tokens, 'liver' AS stem FROM documents d LEFT JOIN (SELECT doc_id, CAST(sum(n) AS INTEGER) AS n FROM cnt GROUP BY doc_id) c USING (doc_id)""")
def sql_functions(spark, base):
    """The operators as SQL functions."""
    pipeline.register_functions(spark)
    _docs(spark, base).createOrReplaceTempView("_tl_documents")
    return spark.sql("SELECT doc_id, tl_content_hash(text) AS hash, size(tl_tokens(text)) AS tokens, tl_stem('livers') AS stem FROM _tl_documents")


# --- statistics ---


@query("""SELECT count(*) AS num_documents, CAST(sum(n_chars) AS BIGINT) AS total_raw_bytes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_text_bytes,
round(avg(n_chars), 2) AS avg_raw_bytes, round(avg(octet_length(encode(text))), 2) AS avg_text_bytes, round(avg(length(text)), 2) AS avg_text_chars,
min(n_chars) AS min_raw_bytes, max(n_chars) AS max_raw_bytes, CAST(min(octet_length(encode(text))) AS INTEGER) AS min_text_bytes, CAST(max(octet_length(encode(text))) AS INTEGER) AS max_text_bytes FROM documents""")
def corpus_stats(spark, base):
    return stats.corpus_stats(_docs(spark, base), "n_chars", "text")


@query("""SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE b || ' B' END AS size
FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)""")
def format_size(spark, base):
    return _docs(spark, base).select("doc_id", text.format_size(F.octet_length("text")).alias("size"))


_FREQ = f"WITH {_TOK}, f AS (SELECT token AS term, count(*) AS freq FROM tok GROUP BY token), r AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq, max(freq) OVER () AS top FROM f)"


@query(_FREQ + r" SELECT regexp_replace(term, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{B}\x{1C}-\x{1F}]+', '') AS term, freq FROM r")
def frequency_file(spark, base):
    """Frequencies as a file of tab-separated lines, and read again, which strips each line."""
    f = index.token_rows(_texts(spark, base)).groupBy("token").agg(F.count("*").alias("freq"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/frequencies-{uuid.uuid4().hex}"
    files.write_lines(f.select(F.concat_ws("\t", "token", F.col("freq").cast("string")).alias("line")), folder)
    return files.read_frequencies(spark, folder)


def _ranks(spark, base) -> DataFrame:
    return stats.ranked(index.token_rows(_texts(spark, base)).groupBy(F.col("token").alias("term")).agg(F.count("*").alias("freq")))


@query(_FREQ + " SELECT rank, term, freq FROM r")
def zipf_rank(spark, base):
    return _ranks(spark, base).select("rank", "term", "freq")


@query(_FREQ + " SELECT rank, round(top / CAST(rank AS DOUBLE), 6) AS expected FROM r")
def zipf_expected(spark, base):
    return _ranks(spark, base).select("rank", F.round("expected", 6).alias("expected"))


@query(_FREQ + " SELECT round(-regr_slope(ln(freq), ln(rank)), 6) AS alpha, round(exp(regr_intercept(ln(freq), ln(rank))), 2) AS c FROM r")
def zipf_fit(spark, base):
    return stats.zipf_fit(_ranks(spark, base)).select(F.round("alpha", 6).alias("alpha"), F.round("c", 2).alias("c"))

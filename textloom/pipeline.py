"""The pipeline's entry points: ingest, export, index, search and statistics over files and tables."""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codec, porter, text, urls
from textloom.operators import extract, ingest, search, stats
from textloom.operators.index import Index
from textloom.plans import query as q
from textloom.session import files as stored_files
from textloom.session import keep
from textloom.sources import api, config, files

#: How records become addresses, and what tells a source's addresses.
BASE_URLS = {"literature": "https://europepmc.org/article/PMC/", "trials": "https://clinicaltrials.gov/study/"}
PATTERNS = {"literature": ["europepmc.org", "ncbi.nlm.nih.gov/pmc"], "trials": ["clinicaltrials.gov"]}
SCHEMAS = {"literature": ingest.ARTICLE, "trials": ingest.TRIAL}
STORE = "url string, raw_html string, source string, crawl_time long, content_hash string"


def documents_of(records: DataFrame, service: str, base_url: str, crawl_time: Column) -> DataFrame:
    """Store rows of a service's records ``r`` that pass its filters."""
    make = ingest.articles if service == "literature" else ingest.trials
    return make(records, base_url, crawl_time)


def ingest_source(records: DataFrame, store: DataFrame, service: str, target: int, order: Column, crawl_time: Column, base_url: str | None = None) -> DataFrame:
    """The documents that a harvest of a service adds to the store: of the records that pass its
    filters those whose url is not stored, each url once, in ``order`` until the service has
    ``target`` documents. ``records`` has ``r``; nothing is written."""
    rows = records.select("r", order.alias("_order"))
    docs = documents_of(rows, service, base_url or BASE_URLS[service], crawl_time)
    # the order of the records by url, which the store's columns don't keep
    key = F.col("r.pmcid") if service == "literature" else F.col("r.protocolSection.identificationModule.nctId")
    first = rows.select(urls.normalize_url(F.concat(F.lit(base_url or BASE_URLS[service]), key)).alias("url"), "_order").groupBy("url").agg(F.min("_order").alias("_order"))
    new = ingest.not_stored(ingest.first_by_url(docs, ["content_hash"]), store).join(first, "url")
    have = ingest.stored_by_source(store, {service: PATTERNS[service]}).select(F.lit(docs_name(service)).alias("source"), "already")
    return ingest.quota(new, "source", ["_order", "url"], {docs_name(service): target}, have).drop("_order")


def docs_name(service: str) -> str:
    return "literature_api" if service == "literature" else "trials_api"


def run_ingest(spark: SparkSession, settings: config.Config, landing: str, at: int | None = None) -> dict[str, int]:
    """Harvests each source's landed pages ``<landing>/<service>`` into the store of the settings, one
    source after the other, and returns how many documents each added. A failure leaves the store as
    the last complete source left it; what is stored is not taken again."""
    api.register(spark)
    added = {}
    for service, target in settings.targets.items():
        folder = f"{settings.store}/documents"
        store = spark.read.schema(STORE).parquet(folder) if stored_files(spark, folder) else spark.createDataFrame([], STORE)
        pages = spark.read.format("paged_records").option("path", f"{landing}/{service}").option("service", service).load()
        pages = pages.withColumn("_n", F.monotonically_increasing_id())
        records = pages.select(F.from_json("value", SCHEMAS[service]).alias("r"), "_n")
        when = F.lit(int(time.time()) if at is None else at)
        new = keep(ingest_source(records, store, service, target, F.col("_n"), when))
        new.select(*[c.split()[0] for c in STORE.split(", ")]).write.mode("append").parquet(folder)
        added[service] = new.count()
    return added


def export_corpus(raw: DataFrame, out: str, order: list[str] | None = None) -> DataFrame:
    """Writes the corpus of the raw documents, a file for each with text, and its manifest, and
    returns the counts of exported and left out documents."""
    c = keep(extract.corpus(raw, order or ["url"]))
    files.write_corpus(c, out)
    files.write_manifest(extract.manifest(c), f"{out}/manifest.tsv")
    exported = c.agg(F.count("*").alias("exported"))
    return exported.join(F.broadcast(raw.agg(F.count("*").alias("_all")))).select("exported", (F.col("_all") - F.col("exported")).alias("errors"))


def build_index(spark: SparkSession, corpus: str, out: str, compress: bool = False) -> DataFrame:
    """Indexes a folder of corpus files and its manifest, and reports on the index in one row: documents,
    terms, postings, bytes stored, seconds, and how much smaller the coded postings are (null if not coded)."""
    began = time.time()
    docs = keep(files.indexed_corpus(spark, corpus).select("doc_id", "title", "url", "body"))
    index = Index.of(docs, F.col("title"), F.col("url"), body="body").write(out, compress)
    size = index.bytes_stored()
    ratio = 1 - size["coded"] / size["postings"] if compress and size["postings"] else None
    return index.meta.select(
        "num_docs",
        "num_terms",
        "num_postings",
        F.lit(sum(size.values())).cast("long").alias("bytes"),
        F.lit(round(time.time() - began, 2)).alias("seconds"),
        F.lit(ratio).cast("double").alias("saved"),
    )


def search_lines(spark: SparkSession, index: str, queries: str | list[str], limit: int = search.PAGE) -> DataFrame:
    """``(query_id, rank, line)`` of the queries of a file or list, those that are not blank, each
    result a line of tab-separated fields."""
    texts = [r.query for r in files.read_queries(spark, queries).collect()] if isinstance(queries, str) else queries
    opened = Index.open(spark, index)
    out = spark.createDataFrame([], "query_id int, rank long, line string")
    for k, text_of in enumerate((t for t in texts if t.strip()), 1):
        lines = search.cli_lines(search.search(opened, text_of, 0, limit))
        out = out.unionByName(lines.select(F.lit(k).alias("query_id"), "rank", "line"))
    return out


def corpus_report(spark: SparkSession, corpus: str) -> DataFrame:
    """Statistics of all files of a corpus folder that are documents."""
    docs = files.read_corpus(spark, f"{corpus}/*.txt", numbered=False)
    return stats.corpus_stats(docs, "raw_bytes", "body")


def register_functions(spark: SparkSession) -> None:
    """The scalar operators as SQL functions: ``tl_tokens``, ``tl_stem``, ``tl_normalize_url``,
    ``tl_content_hash``, ``tl_format_size``, ``tl_tf``, ``tl_idf``, ``tl_tfidf``, ``tl_vbyte_size``; and ``tl_query_terms``, the
    terms a query looks up."""

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(porter.stem, na_action="ignore")

    @F.pandas_udf("array<string>")
    def query_terms(s: pd.Series) -> pd.Series:
        return s.map(lambda x: q.terms(q.parse(x)))

    spark.udf.register("tl_stem", stem)
    spark.udf.register("tl_query_terms", query_terms)
    x, n = F.col("x"), {k: F.col(k) for k in ("tf", "len", "n", "df")}
    one = {
        "tl_tokens(x STRING) RETURNS ARRAY<STRING>": text.tokens(x),
        "tl_normalize_url(x STRING) RETURNS STRING": urls.normalize_url(x),
        "tl_content_hash(x STRING) RETURNS STRING": urls.content_hash(x),
        "tl_format_size(x BIGINT) RETURNS STRING": text.format_size(x),
        "tl_vbyte_size(x BIGINT) RETURNS INT": codec.size_of(x),
        "tl_tf(tf BIGINT, len BIGINT) RETURNS DOUBLE": search.tf(n["tf"], n["len"]),
        "tl_idf(n BIGINT, df BIGINT) RETURNS DOUBLE": search.idf(n["n"], n["df"]),
        "tl_tfidf(tf BIGINT, len BIGINT, n BIGINT, df BIGINT) RETURNS DOUBLE": search.tfidf(n["tf"], n["len"], n["n"], n["df"]),
    }
    for head, body in one.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {_sql_of(body)}")


_CALL = re.compile(r"'(?:[^'\\]|\\.)*'|(?<!\w)(>=|<=|<=>|=|<|>|/|\*|\+|-|%|!|and|or|not)(?=\()", re.S)


def _sql_of(c: Column) -> str:
    """SQL of a column expression; its operators, written as calls, are quoted."""
    return _CALL.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], c._jc.node().sql())

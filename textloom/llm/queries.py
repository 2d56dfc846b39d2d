"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import markup, neardup, packing, reading, terms, tokenizer
from textloom.functions.urls import epoch_seconds, normalize_url
from textloom.operators.incremental import newest
from textloom.session import cut, keep, read, spread


def p1_frequency(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct term of tokens and postings with its counts and mark."""
    tokens, postings = read(spark, base, "tokens"), read(spark, base, "postings")
    return terms.term_frequency({"token": (terms.token_rows(tokens), True), "posting": (terms.posting_rows(postings), True)})


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_frequency(spark, base).where(F.col("mark").isNotNull()).select("origin", "term", "mark")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    pages = read(spark, base, "raw_documents").where(F.col("raw_html").isNotNull())
    return markup.elements(pages, "raw_id", "raw_html", markup.STUDY_TEXT)


def p2_clean_text(spark: SparkSession, base: str) -> DataFrame:
    pages = read(spark, base, "raw_documents")
    return pages.select("raw_id", markup.clean_text(F.col("raw_html"), markup.STUDY_TEXT).alias("text"))


def p4_ppmi(spark: SparkSession, base: str) -> DataFrame:
    """PPMI and weight of every term of every record."""
    scored = terms.distinctiveness(read(spark, base, "postings"), read(spark, base, "forward_entries"), read(spark, base, "index_headers"))
    return scored.select(F.col("record").alias("doc_id"), "term", F.round("ppmi", 6).alias("ppmi"), F.round("weight", 6).alias("weight"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    scored = terms.distinctiveness(read(spark, base, "postings"), read(spark, base, "forward_entries"), read(spark, base, "index_headers"))
    return terms.distinctive_terms(scored, 0.12).select(F.col("record").alias("doc_id"), "term")


def _current_pages(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """``(member, node)``: each manifest entry with the current record of its page, and ``(node, page)`` of these records."""
    raw = read(spark, base, "raw_documents")
    rows = raw.where(F.col("url").isNotNull()).select(normalize_url(F.col("url")).alias("url"), epoch_seconds(F.col("crawl_time")).alias("_t"), "landed_at", "raw_id")
    current = newest(rows, ["url"], [F.col("_t"), F.col("landed_at")], ["raw_id"])
    entries = read(spark, base, "manifest").where(F.col("url").isNotNull()).select("doc_id", "url").distinct()
    members = keep(entries.join(current, "url").select(F.col("doc_id").alias("member"), F.col("raw_id").alias("node")))
    pages = raw.where(F.col("raw_html").isNotNull()).select(F.col("raw_id").alias("node"), F.col("raw_html").alias("page"))
    # shuffled at any size: the stage that reads the pages is bound by the CPU, and files may be few
    return members, pages.hint("merge").join(members.select("node").distinct(), "node", "left_semi")


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    """Group of every record: ``field``, ``doc_id``, ``group_id``; records in no comparison are left out."""
    pages = neardup.page_groups(*_current_pages(spark, base)).select(F.lit("raw_html").alias("field"), F.col("member").alias("doc_id"), F.col("group").alias("group_id"))
    titles = neardup.title_groups(read(spark, base, "manifest").select(F.col("doc_id").alias("member"), "title"))
    return pages.unionByName(titles.select(F.lit("title").alias("field"), F.col("member").alias("doc_id"), F.col("group").alias("group_id")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    groups = cut(p5_groups(spark, base))
    out = None
    for field in ("raw_html", "title"):
        of = groups.where(F.col("field") == field).select(F.col("doc_id").alias("member"), F.col("group_id").alias("group"))
        pairs = neardup.pairs_within(of, "doc_id_a", "doc_id_b").select(F.lit(field).alias("field"), "doc_id_a", "doc_id_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    docs = spread(read(spark, base, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokenizer.encode(F.col("text")).alias("ids"))


def _packed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    limits = read(spark, base, "pack_limits").select("limit_id", "capacity", F.col("tokenizer").alias("limit_key"))
    names = sorted(r[0] for r in limits.select("limit_key").distinct().collect() if r[0])
    docs = spread(read(spark, base, "documents").select("doc_id", "text"))
    n = cut(docs.select("doc_id", tokenizer.count_tokens(F.col("text"), names).alias("n")))
    sizes = F.explode(F.array(*[F.struct(F.lit(t).alias("limit_key"), F.col(f"n.`{t}`").alias("size")) for t in names]))
    items = n.select(F.col("doc_id").alias("id"), sizes.alias("s")).select("id", "s.limit_key", "s.size")
    return packing.pack(items, limits), limits


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    """Container of each text (piece of a text above the capacity) for each limit."""
    packed, _ = _packed(spark, base)
    return packed.select("limit_id", "container", F.col("item").cast("long").alias("doc_id"), "part", F.col("size").alias("tokens"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, base))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "text", "lang")
    return reading.english_levels(docs, read(spark, base, "reading_labels"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_frequency, p2_found, p2_clean_text, p4_found, p4_ppmi, p5_found, p5_groups, p6_ids, p7_containers, p7_fill, p8_found)
}

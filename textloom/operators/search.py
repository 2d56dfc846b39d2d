"""Boolean search ranked by TF-IDF.

A query is one pass: the postings of its terms (pushed down to the scan), one aggregation by
document that decides the boolean part and the score together, and a top-k. Titles and addresses
are fetched for the page shown only.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.plans import query as q

PAGE = 50


def tf(count: Column, length: Column) -> Column:
    return F.when(length > 0, count / length).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(n / df)).otherwise(F.lit(0.0))


def tfidf(count: Column, length: Column, n: Column, df: Column) -> Column:
    return tf(count, length) * idf(n, df)


def _term_stats(index: Index, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Size of the collection and document frequency of the query's terms: a row per term."""
    found = index.terms.where(F.col("term").isin(terms)).select("term", "df").collect() if terms else []
    return index.num_docs, {r.term: r.df for r in found}


def _gathered(index: Index, every: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """A row for each document with one of the terms: its length, and the tf of each in a column of its own."""
    name = {t: f"t{i}" for i, t in enumerate(every)}
    of = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(c) for t, c in name.items()]
    return index.postings.where(F.col("term").isin(every)).groupBy("doc_id").agg(F.first("doc_len").alias("len"), *of), name


def matched(index: Index, query: str | None) -> DataFrame:
    """``(doc_id, tf)`` of every match by one aggregation: tfs of the terms that stand for the match
    are added up, those of a negation count for nothing."""
    node = q.parse(query)
    every = q.terms(node, stemming=index.stemming)
    if not every:
        return index.postings.sparkSession.createDataFrame([], "doc_id long, tf long")
    g, name = _gathered(index, every)

    def combine(kind: str, *x):
        match kind:
            case "term":
                c = F.col(name[q.normalize(x[0], index.stemming)])
                return c.isNotNull(), F.coalesce(c, F.lit(0))
            case "and":
                return x[0][0] & x[1][0], x[0][1] + x[1][1]
            case "or":
                return x[0][0] | x[1][0], F.when(x[0][0], x[0][1]).otherwise(0) + F.when(x[1][0], x[1][1]).otherwise(0)
            case "minus":
                return x[0][0] & ~x[1][0], x[0][1]
        return F.lit(False), F.lit(0)

    hit, tfs = q.evaluate(node, combine)
    return g.where(hit).select("doc_id", tfs.cast("long").alias("tf"))


def scored(index: Index, query: str | None) -> DataFrame:
    """``(doc_id, score)`` of every match, unordered."""
    node = q.parse(query)
    every = q.terms(node, stemming=index.stemming)
    if not every:
        return index.postings.sparkSession.createDataFrame([], "doc_id long, score double")
    n, df = _term_stats(index, every)
    g, name = _gathered(index, every)
    has = {t: F.col(name[t]).isNotNull() for t in every}
    parts = [
        F.when(has[t], tfidf(F.col(name[t]), F.col("len"), F.lit(float(n)), F.lit(df[t]))).otherwise(0.0)
        for t in q.terms(node, positive_only=True, stemming=index.stemming)
        if t in df
    ]
    return g.where(q.predicate(node, has, index.stemming)).select("doc_id", reduce(Column.__add__, parts, F.lit(0.0)).alias("score"))


FOUND = "rank long, doc_id long, score double, title string, url string, total_matched long"


def _slice(index: Index, query: str | None, offset: int, limit: int) -> tuple[list, int]:
    """``limit`` rows of the ranking and the number of all matches, of one pass over the matches."""
    if not (query or "").strip() or limit < 1:
        return [], 0
    total = Observation()
    s = scored(index, query).observe(total, F.count(F.lit(1)).alias("n"))
    rows = s.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit).collect()
    return rows, total.get["n"]


def _shown(index: Index, rows: list, offset: int, total: int) -> DataFrame:
    """The rows of a slice with titles and addresses; their documents are looked up by id."""
    spark = index.postings.sparkSession
    if not rows:
        return spark.createDataFrame([], FOUND)
    ids = [r.doc_id for r in rows]
    page = pa.table({"rank": pa.array(range(offset + 1, offset + len(rows) + 1), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array([r.score for r in rows], pa.float64())})
    docs = index.docs.where(F.col("doc_id").isin(ids)).select("doc_id", "title", "url")
    hydrated = docs.join(F.broadcast(spark.createDataFrame(page)), "doc_id")
    return hydrated.select("rank", "doc_id", "score", "title", "url", F.lit(total).cast("long").alias("total_matched"))


def search(index: Index, query: str | None, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A slice of the ranking, best first, of equal scores the lower id: ``(rank, doc_id, score,
    title, url, total_matched)``. Blank queries and those without a match give no rows. The slice's
    ids come to the driver, ``limit`` at most; matches are counted in the pass that ranks them."""
    offset = max(0, offset)
    rows, total = _slice(index, query, offset, limit)
    return _shown(index, rows, offset, total)


def search_page(index: Index, query: str | None, page: int = 1, size: int = PAGE) -> DataFrame:
    """A page of results; pages below 1 and above the last are the first and the last."""
    offset = (max(1, page) - 1) * size
    rows, total = _slice(index, query, offset, size)
    if not rows and total:
        offset = (total - 1) // size * size
        rows, total = _slice(index, query, offset, size)
    return _shown(index, rows, offset, total)


def search_many(index: Index, queries: dict[int, str], limit: int = PAGE) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of several queries in one pass over their postings.

    Rows of each document are gathered per query by one aggregation. The ranking keeps the best
    ``limit`` of each partition before it is complete, so no query's matches meet in one task.
    """
    nodes = {k: q.parse(v) for k, v in queries.items()}
    terms_of = {k: q.terms(n, stemming=index.stemming) for k, n in nodes.items()}
    every = sorted({t for ts in terms_of.values() for t in ts})
    spark = index.postings.sparkSession
    if not every:
        return spark.createDataFrame([], "query_id int, rank int, doc_id long, score double")
    n, df = _term_stats(index, every)
    g, name = _gathered(index, every)
    has = {t: F.col(name[t]).isNotNull() for t in every}
    hits = []
    for k, node in nodes.items():
        parts = [F.when(has[t], tfidf(F.col(name[t]), F.col("len"), F.lit(float(n)), F.lit(df[t]))).otherwise(0.0) for t in q.terms(node, True, index.stemming) if t in df]
        hit = F.struct(F.lit(k).alias("query_id"), reduce(Column.__add__, parts, F.lit(0.0)).alias("score"))
        hits.append(F.when(q.predicate(node, has, index.stemming), hit))
    rows = g.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.query_id", "doc_id", "h.score")
    order = "ORDER BY score DESC, doc_id"
    some = rows.withColumn("part", F.spark_partition_id()).withColumn("r", F.expr(f"row_number() OVER (PARTITION BY query_id, part {order})")).where(F.col("r") <= limit)
    best = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY query_id {order})")).where(F.col("rank") <= limit)
    return best.select("query_id", "rank", "doc_id", "score")


def joined(index: Index, query: str | None) -> DataFrame:
    """``(doc_id, tf)`` by joins of posting lists: conjunction inner, disjunction full outer with the
    tfs added, negation anti. The plain form of each operator, and a check of the fused plan."""
    p = index.postings.select("term", "doc_id", "tf")

    def combine(kind: str, *x: DataFrame) -> DataFrame:
        if kind == "term":
            return p.where(F.col("term") == q.normalize(x[0], index.stemming)).select("doc_id", "tf")
        if kind == "none":
            return p.where(F.lit(False)).select("doc_id", "tf")
        a, b = x[0], x[1].withColumnRenamed("tf", "tf2")
        if kind == "minus":
            return a.join(b, "doc_id", "left_anti")
        how = "inner" if kind == "and" else "full_outer"
        return a.join(b, "doc_id", how).select("doc_id", (F.coalesce("tf", F.lit(0)) + F.coalesce("tf2", F.lit(0))).alias("tf"))

    return q.evaluate(q.parse(query), combine)


def cli_lines(results: DataFrame) -> DataFrame:
    """Results as tab-separated lines: id, score with six decimals, title, url."""
    field = lambda c: F.translate(F.coalesce(c, F.lit("")), "\t\n", "  ")
    return results.select("rank", F.format_string("%d\t%.6f\t%s\t%s", "doc_id", "score", field("title"), field("url")).alias("line"))

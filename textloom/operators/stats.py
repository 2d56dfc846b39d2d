"""Statistics of corpus, tokens and term ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import format_size
from textloom.operators.extract import dense_ids


def corpus_stats(docs: DataFrame, raw_bytes: str, body: str) -> DataFrame:
    """One row about documents, their raw and text sizes in bytes, and characters; averages rounded
    to two decimals, null for an empty corpus. Null texts have no size."""
    raw, size = F.col(raw_bytes), F.octet_length(body)
    return docs.agg(
        F.count("*").alias("num_documents"),
        F.sum(raw).alias("total_raw_bytes"),
        F.sum(size).alias("total_text_bytes"),
        F.round(F.avg(raw), 2).alias("avg_raw_bytes"),
        F.round(F.avg(size), 2).alias("avg_text_bytes"),
        F.round(F.avg(F.char_length(body)), 2).alias("avg_text_chars"),
        F.min(raw).alias("min_raw_bytes"),
        F.max(raw).alias("max_raw_bytes"),
        F.min(size).alias("min_text_bytes"),
        F.max(size).alias("max_text_bytes"),
    )


def readable(stats: DataFrame) -> DataFrame:
    return stats.select(*[format_size(F.col(c)).alias(c) for c in ("total_raw_bytes", "total_text_bytes")])


def token_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("num_tokens"), F.sum(F.char_length("token")).alias("total_chars"))


def ranked(frequencies: DataFrame) -> DataFrame:
    """``(rank, term, freq, expected)`` in descending order of frequency, of equal ones by term;
    ``expected`` is the greatest frequency over the rank. Ranks are given by ranges, not in one task."""
    f = dense_ids(frequencies.select((-F.col("freq")).alias("_neg"), "term", "freq"), ["_neg", "term"], "_i")
    top = frequencies.agg(F.max("freq").alias("_top"))
    return f.join(F.broadcast(top)).select((F.col("_i") + 1).alias("rank"), "term", "freq", (F.col("_top") / (F.col("_i") + 1)).alias("expected"))


def zipf_fit(ranks: DataFrame) -> DataFrame:
    """Exponent and constant of freq = C / rank^alpha by least squares on logarithms."""
    y, x = F.log(F.col("freq").cast("double")), F.log(F.col("rank").cast("double"))
    return ranks.agg((-F.regr_slope(y, x)).alias("alpha"), F.exp(F.regr_intercept(y, x)).alias("c"))


def synthetic_frequencies(spark: SparkSession, n: int = 50_000, scale: float = 320_000.0, alpha: float = 1.07, seed: int = 42) -> DataFrame:
    """Frequencies that follow the law with five per cent of noise, at least 1."""
    r = spark.range(1, n + 1)
    freq = F.greatest(F.lit(1), (F.floor(F.lit(scale) / F.pow("id", F.lit(alpha))) * (1 + 0.05 * F.randn(seed))).cast("long"))
    return r.select(F.format_string("term%d", "id").alias("term"), freq.alias("freq"))

"""Reading level by smoothed unigram language models, one for each level.

The models are fitted on the words of labelled texts; a text gets the level under which its words
are most likely, given how frequent the level is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("plain", "general", "expert")
#: A word: letters, with an apostrophe or hyphen inside. Digits and markup are no evidence.
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass(frozen=True)
class LevelModels:
    levels: tuple[str, ...]
    index: dict[str, int]
    log_p: np.ndarray  # words x levels; row 0 is for words not seen
    prior: np.ndarray

    def posteriors(self, text: str) -> np.ndarray:
        rows = [self.index.get(w, 0) for w in words(text)]
        return self.prior + self.log_p[rows].sum(axis=0)


def fit_counts(counts: dict[tuple[str, str], int], texts: dict[str, int], levels: tuple[str, ...] = LEVELS, gamma: float = 0.5) -> LevelModels:
    """Unigram models of counts by ``(word, level)`` with ``gamma`` added to every count, and the number
    of texts of each level. A level without texts is never assigned. The prior is the share of the
    texts, smoothed alike."""
    index = {w: k for k, w in enumerate(sorted({w for w, _ in counts}), 1)}
    table = np.zeros((len(index) + 1, len(levels)))
    for (w, level), c in counts.items():
        table[index[w], levels.index(level)] += c
    n = np.array([texts.get(x, 0) for x in levels], float)
    log_p = np.log((table + gamma) / (table.sum(axis=0) + gamma * len(table)))
    log_p[0] = 0.0  # a word that no level knows tells nothing
    prior = np.where(n > 0, np.log((n + 1.0) / (n.sum() + len(levels))), -np.inf)
    return LevelModels(levels, index, log_p, prior)


def fit(texts: list[tuple[str, str]], levels: tuple[str, ...] = LEVELS, gamma: float = 0.5) -> LevelModels:
    """Models of ``(text, level)`` pairs, see :func:`fit_counts`."""
    counts = Counter((w, level) for text, level in texts for w in words(text))
    return fit_counts(counts, Counter(level for _, level in texts), levels, gamma)


def agreed_levels(labels: DataFrame, levels: tuple[str, ...] = LEVELS, most: int = 3000) -> DataFrame:
    """``(doc_id, level)`` of at most ``most`` documents that the readers agree on. Documents whose labels are
    tied, unknown or null are left out; of more than ``most`` documents those with the least hash of
    their id are taken, wherever they stand."""
    votes = labels.where(F.col("reading_level").isin(*levels)).groupBy("doc_id", "reading_level").agg(F.count("*").alias("votes"))
    best = votes.groupBy("doc_id").agg(F.max("votes").alias("votes"))
    agreed = votes.join(best, ["doc_id", "votes"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("reading_level").alias("level")).where("n = 1")
    return agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "level")


def labelled(documents: DataFrame, labels: DataFrame, levels: tuple[str, ...] = LEVELS, most: int = 3000) -> DataFrame:
    """``(text, level)`` of the documents of :func:`agreed_levels` that have a text: ``most`` rows at most."""
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(agreed_levels(labels, levels, most)), "doc_id").select("text", "level")


def labelled_texts(documents: DataFrame, labels: DataFrame, levels: tuple[str, ...] = LEVELS, most: int = 3000) -> list[tuple[str, str]]:
    """The rows of :func:`labelled`, for samples that are known to be small."""
    return [(r.text, r.level) for r in labelled(documents, labels, levels, most).collect()]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, level, n)`` of texts; the row without word has the number of texts."""
    for b in batches:
        n: Counter = Counter()
        for text, level in zip(b.column("text").to_pylist(), b.column("level").to_pylist(), strict=True):
            n[None, level] += 1
            n.update((w, level) for w in words(text))
        keys = list(n)
        yield pa.record_batch({"word": pa.array([w for w, _ in keys], pa.string()), "level": pa.array([x for _, x in keys], pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def fitted(documents: DataFrame, labels: DataFrame, most: int = 3000, vocabulary: int = 200_000) -> LevelModels | None:
    """Models of the labelled sample, counted on the executors; nothing without a usable label. Of
    the sample's words the ``vocabulary`` commonest (of equals the first by name) are modelled, and
    only their counts come to the driver."""
    counts = labelled(documents, labels, most=most).mapInArrow(_word_counts, "word string, level string, n long").groupBy("word").agg(
        *[F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias(x) for x in LEVELS]
    )
    rows = counts.orderBy(F.col("word").isNotNull(), F.desc(sum((F.col(x) for x in LEVELS[1:]), F.col(LEVELS[0]))), "word").limit(vocabulary + 1).collect()
    if not rows or rows[0].word is not None:
        return None
    return fit_counts({(r.word, x): r[x] for r in rows[1:] for x in LEVELS if r[x]}, {x: rows[0][x] for x in LEVELS})


def is_english(lang: Column) -> Column:
    """Whether a language code or name says English, however spelled; false for null."""
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"^(?:en|eng|english|anglais|englisch)(?:[-_. (].*)?$"), F.lit(False))


def reading_level(text: Column, models: LevelModels) -> Column:
    """Level of the text; null for a null text. A text without a known word gets the commonest level."""

    @F.pandas_udf("string")
    def level(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([None if t is None else models.levels[int(models.posteriors(t).argmax())] for t in texts], dtype=object)

    return level(text)


def english_levels(documents: DataFrame, labels: DataFrame, min_words: int = 60, most: int = 3000) -> DataFrame:
    """``(doc_id, reading_level)`` of every English document of at least ``min_words`` words
    (runs without white space). Without any usable label there are no models and no rows."""
    models = fitted(documents, labels, most)
    long_enough = F.size(F.split(F.btrim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")) >= min_words
    chosen = documents.where(is_english(F.col("lang")) & F.col("text").isNotNull() & long_enough)
    if models is None:
        return chosen.limit(0).select("doc_id", F.lit(None).cast("string").alias("reading_level"))
    return chosen.select("doc_id", reading_level(F.col("text"), models).alias("reading_level"))

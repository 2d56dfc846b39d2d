"""File formats of the pipeline: corpus files, manifest, frequencies, queries, and their writers."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import first_bytes, one_line, strip


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, url, title, text_size_bytes)`` of the lines that begin with a digit."""
    lines = spark.read.text(path).where(F.col("value").rlike("^[0-9]"))
    f = F.split("value", "\t")
    return lines.select(
        F.regexp_extract("value", "^([0-9]+)", 1).cast("long").alias("doc_id"),
        F.try_element_at(f, F.lit(2)).alias("url"),
        F.try_element_at(f, F.lit(3)).alias("title"),
        F.try_element_at(f, F.lit(4)).try_cast("int").alias("text_size_bytes"),
    )


#: Bytes of a title and of an address that the index keeps.
TITLE_BYTES, URL_BYTES = 1023, 2047


def read_corpus(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """``(doc_id, title, url, body, raw_bytes)`` of the files ``<doc_id>.txt``: a line of title, a
    line of url, the rest. Files of fewer than three lines are left out, and files that can't be
    read. Without ``numbered``, every file counts, and one without a number has a null id."""
    files = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(path, wholetext=True)
    files = files.select("value", F.regexp_extract("_metadata.file_name", r"^([0-9]+)\.txt$", 1).alias("name"), F.col("_metadata.file_size").alias("raw_bytes"))
    lines = F.split("value", r"\r\n|\n|\r", 3)
    kept = files.where((F.size(lines) >= 3) & ((F.col("name") != "") | F.lit(not numbered)))
    return kept.select(
        F.col("name").try_cast("long").alias("doc_id"), strip(lines[0]).alias("title"), strip(lines[1]).alias("url"), lines[2].alias("body"), "raw_bytes"
    )


def indexed_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, url, body, raw_bytes)`` of the manifest's documents whose file is there, with
    title and url cut to the bytes that the index keeps."""
    docs = indexed_files(read_manifest(spark, f"{path}/manifest.tsv"), read_corpus(spark, path))
    return docs.withColumns({"title": first_bytes(F.col("title"), TITLE_BYTES), "url": first_bytes(F.col("url"), URL_BYTES)})


def indexed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of the manifest whose file is there."""
    return manifest.select("doc_id").distinct().join(files, "doc_id")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``(term, freq)`` of the lines of exactly two fields, the second a number."""
    f = F.split(strip(F.col("value")), "\t")
    rows = spark.read.text(path).where(F.size(f) == 2)
    return rows.select(f[0].alias("term"), strip(f[1]).try_cast("long").alias("freq")).where("freq IS NOT NULL")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(query)``, one for each line that is not empty."""
    return spark.read.text(path).select(F.regexp_replace("value", "[\r\n]+$", "").alias("query")).where("query <> ''")


def read_json_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of landed API pages, one JSON object in a line, in the column ``r``. Values of another
    type than the schema's come out as null."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL")


def write_manifest(m: DataFrame, path: str) -> None:
    m.select("doc_id", "url", "title", "text_size_bytes").write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A file ``<doc_id>.txt`` for each document in a folder that all executors share. Files are
    written beside their place and moved, so a task that runs twice leaves whole files."""

    def write(rows: Iterator) -> None:
        import os
        import uuid

        folder = PurePosixPath(urlsplit(path).path)
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{r.doc_id}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(f"{r.title or ''}\n{r.url or ''}\n{r.body or ''}\n")
            os.replace(part, f"{folder}/{r.doc_id}.txt")

    corpus.select("doc_id", one_line(F.col("title")).alias("title"), one_line(F.col("url")).alias("url"), "body").foreachPartition(write)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)

"""Continuous ingest: landed documents into the store, each batch once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.urls import normalize_url, stored_hash
from textloom.operators.incremental import newest
from textloom.operators.ingest import first_by_url, upsert
from textloom.session import cut, publish

LANDED = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("raw_html", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("crawl_time", T.LongType()),
        T.StructField("content_hash", T.StringType()),
    ]
)
COLUMNS = [f.name for f in LANDED.fields]


class StoreStream:
    """Upserts batches into a store under ``root`` that grows by what changed.

    A batch writes the new form of the documents it inserts or changes, and nothing else, into a
    folder of its own that is moved to its place when it is complete. Folders are numbered by the
    store; the stream and batch they come from are part of the name, so a batch that is tried again
    is known, and a stream that starts anew with a new checkpoint, whose batches count from 0 again,
    goes on after what is there. A document's newest row is its current form.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _changes(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/n=*"))
        return sorted(s.getPath().getName() for s in done or [])

    def _rows(self) -> DataFrame:
        """All rows ever written, with the number ``_n`` of their change."""
        names = self._changes()
        if not names:
            return self.spark.createDataFrame([], LANDED).withColumn("_n", F.lit(0).cast("long"))
        rows = self.spark.read.schema(LANDED).parquet(*[f"{self.root}/{n}" for n in names])
        return rows.withColumn("_n", F.regexp_extract("_metadata.file_path", r"/n=(\d+)-", 1).cast("long"))

    def current(self, of: DataFrame | None = None) -> DataFrame:
        """The current form of each document, or of those with a url in ``of``."""
        rows = self._rows()
        if of is not None:
            rows = rows.join(of.select("url"), "url", "left_semi")
        return newest(rows, ["url"], [F.col("_n")], [c for c in COLUMNS if c != "url"]).select(*COLUMNS)

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        names = self._changes()
        mark = f"-{stream or 'batch'}-{batch_id}"
        if any(n.endswith(mark) for n in names):
            return
        b = batch.select(
            normalize_url(F.col("url")).alias("url"), "raw_html", "source", "crawl_time", stored_hash(F.col("content_hash"), F.col("raw_html")).alias("content_hash")
        )
        b = b.withColumn("_late", -F.coalesce("crawl_time", F.lit(0)))
        late = cut(first_by_url(b, ["_late", "content_hash"]).select(*COLUMNS))
        changed = upsert(self.current(late), late).where("action <> 'keep'").select(*COLUMNS)
        number = 1 + max((int(n[2:].split("-")[0]) for n in names), default=0)
        made = f"{self.root}/unfinished/{mark[1:]}"
        changed.write.mode("overwrite").parquet(made)
        publish(self.spark, made, f"{self.root}/n={number:012d}{mark}")

    def compact(self) -> None:
        """One folder with the current form of all documents in place of all folders so far. They are
        removed after it is in its place; rows that are in both count once."""
        names = self._changes()
        if len(names) < 2:
            return
        jvm = self.spark._jvm
        made = f"{self.root}/unfinished/compact"
        self.current().write.mode("overwrite").parquet(made)
        # the number of the newest and its mark, so that batches that are tried again are still known
        marks = [n.split("-", 1)[1] for n in names]
        place = f"{self.root}/n={names[-1][2:].split('-')[0]}-compact-{marks[-1]}"
        publish(self.spark, made, place)
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}"), True)

    def start(self, landing: str, checkpoint: str, **trigger):
        """Starts the stream over Parquet files that land in a folder. The stream is named by its checkpoint."""
        stream = self.spark.readStream.schema(LANDED).parquet(landing)

        def batch(df: DataFrame, batch_id: int) -> None:
            name = json.loads(self.spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
            self.apply(df, batch_id, name.replace("-", ""))

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()

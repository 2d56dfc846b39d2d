"""Processing only what is new or changed since the last run that succeeded.

A *listing* says what there is now (key, checksum); a *manifest* says what which batch has
processed. Work is the anti-join of the two. A batch writes its output under its own identifier,
replacing whatever an earlier attempt of that batch left there, and only then commits its rows to
the manifest: a failure before the commit leaves the listing to be found again, a failure after it
leaves nothing to do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.urls import content_hash, epoch_seconds, normalize_url, stored_hash
from textloom.session import checkpoint_dir, cut, files, publish, read


def newest(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Of the rows of each key the one that is greatest in ``order``, then in ``values``; null keys
    form one group. Aggregates before the shuffle, so repeated keys cost nothing."""
    best = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *values)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def pending(listing: DataFrame, manifest: DataFrame, key: str, checksum: str) -> DataFrame:
    """Rows of ``listing`` whose key the manifest lacks or holds with another checksum.

    ``manifest`` has one row per key. A null checksum differs from any other value and equals
    null; a null key in the listing matches nothing and is always pending.
    """
    done = manifest.select(F.col(key).alias("_k"), F.col(checksum).alias("_c"))
    same = (listing[key] == done["_k"]) & listing[checksum].eqNullSafe(done["_c"])
    return listing.join(done, same, "left_anti")


def committed(state: DataFrame, runs: DataFrame, key: str, checksum: str, run: str, status: str, good: str) -> DataFrame:
    """The manifest that a log of attempts amounts to: for each key the row of its highest run
    that succeeded. Rows of runs that failed, or that the table of runs lacks, don't count."""
    ok = runs.where(F.col(status) == good).select(F.col(run)).distinct()
    return newest(state.join(ok, run, "left_semi"), [key], [F.col(run)], [checksum])


def current_pages(raw: DataFrame) -> DataFrame:
    """``(url, content_hash, raw_id)`` of the current record of each page: the latest
    ``crawl_time`` (null is earliest); of several, the latest landed, then the highest id."""
    rows = raw.where(F.col("url").isNotNull()).select(
        normalize_url(F.col("url")).alias("url"),
        epoch_seconds(F.col("crawl_time")).alias("_t"),
        "landed_at",
        "raw_id",
        stored_hash(F.col("content_hash"), F.col("raw_html")).alias("content_hash"),
    )
    return newest(rows, ["url"], [F.col("_t"), F.col("landed_at")], ["raw_id", "content_hash"])


def changed_pages(raw: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """``(url, content_hash)`` of the pages that no run that succeeded has processed in their
    current form, each once. Pages without any hash (neither stored nor a body) have a null hash."""
    log = state.select(
        normalize_url(F.col("url")).alias("url"),
        F.lower(F.regexp_replace("content_hash", r"^\s+|\s+$", "")).alias("content_hash"),
        "run_id",
    )
    manifest = committed(log, runs, "url", "content_hash", "run_id", "status", "succeeded")
    return pending(current_pages(raw), manifest, "url", "content_hash").select("url", "content_hash")


MANIFEST = "path string, size long, modified timestamp, checksum string, batch_id string, seq long"


class FileBatches:
    """Runs a transformation over the input files that are new or changed.

    ``root`` is a folder all executors share. ``manifest/`` holds the committed rows of each batch,
    moved there as a whole when its output is complete, ``output/batch_id=…`` the rows of a batch.
    Output of batches without a commit is invisible and replaced when the batch is tried again. A
    file that is no longer there is committed with a null checksum.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, source: str | list[str], pattern: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)

    def listing(self, source: str, pattern: str = "*") -> DataFrame:
        """Path, size and time of the input files; their content is not read."""
        return self._files(source, pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def manifest(self) -> DataFrame:
        if not files(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/*")

    def latest(self) -> DataFrame:
        """The newest committed row of each path."""
        return newest(self.manifest(), ["path"], [F.col("seq")], ["size", "modified", "checksum", "batch_id"])

    def output(self) -> DataFrame | None:
        """Rows of all committed batches, with their ``batch_id``; nothing before the first. It is a
        log: rows of versions of a file that a later batch replaced stay in it."""
        ids = [r[0] for r in self.manifest().select("batch_id").distinct().collect()]  # one for each run
        paths = [f"{self.root}/output/batch_id={b}" for b in ids if files(self.spark, f"{self.root}/output/batch_id={b}")]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/output").option("recursiveFileLookup", "false").parquet(*paths)

    def current(self, path: str = "path") -> DataFrame | None:
        """Of the rows that name the input they come from in ``path``, those of the newest version of each file that is still there."""
        rows = self.output()
        if rows is None:
            return None
        now = self.latest().where(F.col("checksum").isNotNull()).select(F.col("path").alias(path), F.col("batch_id").cast("string").alias("_batch"))
        at = rows.withColumn("_batch", F.col("batch_id").cast("string"))
        return at.join(now, [path, "_batch"], "left_semi").drop("_batch")

    def run(self, source: str, transform: Callable[[list[str]], DataFrame], pattern: str = "*", batch_id: str | None = None, most: int = 10_000) -> str | None:
        """Processes what is pending as one batch; the batch's identifier, or nothing if there was
        no work or that batch is already committed. ``transform`` gets the paths of the files, at
        most ``most`` in a batch; what is beyond stays pending, and the next run takes it.

        Only files whose size or time differs from the manifest's are read for their checksum; one
        whose content is the same after all is committed as part of the batch that has its rows."""
        done = self.manifest()
        if batch_id is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
            return None
        latest = cut(self.latest())
        seen = latest.where(F.col("checksum").isNotNull())
        found = self.listing(source, pattern)
        same = (found.path == seen.path) & (found.size == seen.size) & (found.modified == seen.modified)
        paths = [r.path for r in found.join(seen, same, "left_anti").orderBy("path").limit(most).collect()]
        gone = seen.select("path", "batch_id").join(found.select("path"), "path", "left_anti")
        if not paths and gone.isEmpty():
            return None
        batch_id = batch_id or uuid.uuid4().hex
        seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
        commit = gone.select("path", F.lit(-1).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("checksum"), F.lit(batch_id).alias("batch_id"))
        changed = False
        if paths:
            read = self._files(paths, pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("checksum"))
            before = seen.select("path", F.col("checksum").alias("_had"), F.col("batch_id").alias("_batch"))
            read = cut(read.join(before, "path", "left").withColumn("_new", ~F.col("checksum").eqNullSafe(F.col("_had"))))
            work = [r.path for r in read.where("_new").select("path").orderBy("path").collect()]
            changed = bool(work)
            if work:
                transform(work).write.mode("overwrite").parquet(f"{self.root}/output/batch_id={batch_id}")
            commit = commit.unionByName(read.select("path", "size", "modified", "checksum", F.when(F.col("_new"), F.lit(batch_id)).otherwise(F.col("_batch")).alias("batch_id")))
        self._commit(commit.withColumn("seq", F.lit(seq).cast("long")), batch_id)
        return batch_id if changed or not gone.isEmpty() else None

    def _commit(self, rows: DataFrame, batch_id: str) -> None:
        made = f"{self.root}/uncommitted/{batch_id}"
        rows.write.mode("overwrite").parquet(made)
        publish(self.spark, made, f"{self.root}/manifest/{batch_id}")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return changed_pages(read(spark, base, "raw_documents"), read(spark, base, "crawl_state"), read(spark, base, "crawl_runs"))


def p3_files(spark: SparkSession, base: str) -> DataFrame:
    """The landed files as batches: a run processes what is pending and commits it, a second one finds
    nothing to do. ``(raw_id, content_hash)`` of the rows of the newest version of each file."""
    batches = FileBatches(spark, f"{checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}")
    for _ in range(2):

        def transform(paths: list[str]) -> DataFrame:
            pages = spark.read.parquet(*paths)
            return pages.select(F.col("_metadata.file_path").alias("path"), "raw_id", content_hash(F.col("raw_html")).alias("content_hash"))

        while batches.run(f"{base}/raw_documents.parquet", transform, "*.parquet"):
            pass
    return batches.current().select("raw_id", "content_hash")


P3_FILES_SQL = "SELECT raw_id, md5(raw_html) AS content_hash FROM raw_documents"

P3_SQL = r"""
WITH r AS (
  SELECT trim(url) AS u, raw_id, landed_at,
         CASE WHEN crawl_time > 1000000000000 THEN crawl_time / 1000.0 ELSE CAST(crawl_time AS DOUBLE) END AS t,
         CASE WHEN trim(content_hash) <> '' THEN lower(trim(content_hash)) ELSE md5(raw_html) END AS content_hash
  FROM raw_documents WHERE url IS NOT NULL),
n AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))
         || regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS url
  FROM r),
cur AS (
  SELECT url, content_hash FROM n
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY t DESC NULLS LAST, landed_at DESC NULLS LAST, raw_id DESC) = 1),
s AS (
  SELECT lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))
         || regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS url,
         lower(trim(content_hash)) AS content_hash, run_id
  FROM crawl_state WHERE run_id IN (SELECT run_id FROM crawl_runs WHERE status = 'succeeded')),
last AS (SELECT url, content_hash FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY run_id DESC, content_hash DESC) = 1)
SELECT c.url, c.content_hash FROM cur c LEFT JOIN last l ON c.url = l.url
WHERE l.url IS NULL OR l.content_hash IS DISTINCT FROM c.content_hash
"""

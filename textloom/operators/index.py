"""Inverted and forward index as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codec, porter, text
from textloom.session import checkpoint_dir, files, keep, publish, version

VERSION = 2


def token_rows(docs: DataFrame, body: str = "text") -> DataFrame:
    """``(doc_id, token)``, a row per token; documents without tokens have none."""
    return docs.select("doc_id", F.explode(text.tokens(F.col(body))).alias("token"))


def positioned(docs: DataFrame, body: str = "text") -> DataFrame:
    return docs.select("doc_id", F.explode(text.token_positions(F.col(body))).alias("t")).select("doc_id", "t.position", F.col("t.text").alias("token"))


def token_counts(docs: DataFrame, body: str = "text") -> DataFrame:
    return token_rows(docs, body).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``(token, term)``: every distinct token with its stem."""
    return porter.add_stem(counts.select("token").distinct(), "token", "term")


def stemmed(counts: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)`` of token counts: these alone meet the stems of the vocabulary. A stem
    that is empty is no term."""
    terms = counts.join(vocabulary(counts), "token").where("term <> ''")
    return terms.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def postings(docs: DataFrame, stemming: bool = True, body: str = "text") -> DataFrame:
    """``(term, doc_id, tf)``, one row for each term of each document. Words are counted within
    documents first; only the counts meet the stems of the vocabulary."""
    counts = token_counts(docs, body)
    return stemmed(counts) if stemming else counts.select(F.col("token").alias("term"), "doc_id", "tf")


def document_lengths(docs: DataFrame, body: str = "text") -> DataFrame:
    """``(doc_id, total_tokens)`` of every document, those without tokens too. Narrow: no shuffle."""
    return docs.select("doc_id", F.size(text.tokens(F.col(body))).cast("long").alias("total_tokens"))


def term_table(p: DataFrame) -> DataFrame:
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def forward(docs: DataFrame, title: Column, url: Column, body: str = "text") -> DataFrame:
    return docs.select("doc_id", title.alias("title"), url.alias("url"), F.size(text.tokens(F.col(body))).cast("long").alias("total_tokens"))


#: Documents with the same id divided by this share a block of a posting list.
BLOCK = 1 << 16


def postings_lists(p: DataFrame) -> DataFrame:
    """For each term its documents, ascending, and their tf in the same order: one row holds a whole
    list. Lists of any length are stored in blocks, see :func:`postings_blocks`."""
    lists = p.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("l"))
    return lists.select("term", F.col("l.doc_id").alias("doc_ids"), F.col("l.tf").alias("tfs"), F.size("l").cast("long").alias("df"))


def postings_blocks(p: DataFrame) -> DataFrame:
    """``(term, block, n, doc_ids, tfs)``: posting lists cut by document id, so that no row holds more than BLOCK postings."""
    lists = p.groupBy("term", F.floor(F.col("doc_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("l"))
    return lists.select("term", "block", F.size("l").alias("n"), F.col("l.doc_id").alias("doc_ids"), F.col("l.tf").alias("tfs"))


def encoded_postings(p: DataFrame) -> DataFrame:
    """``(term, block, n, code)``: of each block the deltas of the documents, then the tfs, in variable
    bytes. The first document counts from the beginning of its block, so blocks can be read alone."""
    b = postings_blocks(p)
    inside = F.transform("doc_ids", lambda d: d - F.col("block") * BLOCK)
    return b.select("term", "block", "n", codec.vbyte_encode(F.concat(codec.deltas(inside), "tfs")).alias("code"))


CODED = "term string, block long, n int, code binary"
#: Postings that a worker has in arrays at a time, beyond those of one document or block.
HELD = 1 << 20


class _Words(dict):
    """Number of the term of each word met so far, -1 for one that is no token; ``terms`` has the terms by number."""

    def __init__(self, stemming: bool):
        self.stemming, self.terms, self.numbers = stemming, [], {}

    def __missing__(self, word: bytes) -> int:
        term = word if text.is_token_py(word) else b""
        if term and self.stemming:
            term = porter.stem(word.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
        number = -1
        if term:
            number = self.numbers.setdefault(term, len(self.terms))
            if number == len(self.terms):
                self.terms.append(term)
        self[word] = number
        return number


_WORDS: dict[bool, _Words] = {}


def _words(stemming: bool) -> _Words:
    """The words that this worker has met, for a batch; at 2,000,000 it begins anew."""
    if stemming not in _WORDS or len(_WORDS[stemming]) > 2_000_000:
        _WORDS[stemming] = _Words(stemming)
    return _WORDS[stemming]


def _coded(group: np.ndarray, inside: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of documents and codes of the blocks of postings, which are sorted by ``group``, one number
    for each block, and their place in it. The tfs of postings of one document add up."""
    if not len(group):
        return group, pa.array([], pa.binary())
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    group, inside, tf = group[at], inside[at], np.add.reduceat(tf, at)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(first, append=len(group))
    delta = np.diff(inside, prepend=0)
    delta[first] = inside[first]
    place = np.arange(len(group)) + np.repeat(first, n)
    values = np.empty(2 * len(group), np.int64)
    values[place] = delta
    values[place + np.repeat(n, n)] = tf
    return n, codec.encode_runs(values, 2 * n)


def _postings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the block and tf of each posting of coded blocks."""
    n = b.column("n").to_numpy().astype(np.int64)
    values = codec.decode_runs(b.column("code"))
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) + np.repeat(first, n)
    sums = np.cumsum(values[place])
    inside = sums - np.repeat(np.concatenate([[0], sums])[first], n)
    return np.repeat(np.arange(len(n)), n), inside, values[place + np.repeat(n, n)]


def _parts(b: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch of coded blocks cut at some of the rows ``starts``, the first of which is 0, about every
    HELD postings; with the starts within each part."""
    before = np.concatenate([[0], np.cumsum(b.column("n").to_numpy(), dtype=np.int64)])[starts]
    cuts = np.flatnonzero(np.diff(before // HELD, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
        end = starts[hi] if hi < len(starts) else b.num_rows
        yield b.slice(starts[lo], end - starts[lo]), starts[lo:hi] - starts[lo]


def _code_texts(stemming: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def coded(docs: list[int], counts: list[tuple[np.ndarray, np.ndarray]], terms: list[bytes]) -> pa.RecordBatch:
        ids, rank = np.unique(np.array(docs, np.int64), return_inverse=True)
        term = np.concatenate([t for t, _ in counts])
        tf = np.concatenate([f for _, f in counts])
        key = term << 32 | np.repeat(rank, [len(t) for t, _ in counts])
        order = np.argsort(key)
        order = order[np.searchsorted(term[order], 0) :]  # words that are no tokens come first
        term, doc, tf = term[order], ids[key[order] & 0xFFFFFFFF], tf[order]
        block = doc // BLOCK
        new = np.diff(term, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool)
        n, code = _coded(np.cumsum(new), doc - block * BLOCK, tf)
        first = np.flatnonzero(new)
        words = pa.array([terms[i] for i in term[first]], pa.binary()).view(pa.string())
        return pa.record_batch({"term": words, "block": pa.array(block[first]), "n": pa.array(n.astype(np.int32)), "code": code})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(stemming)
            docs, counts, held = [], [], 0
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body").cast(pa.binary()).to_pylist(), strict=True):
                if c := text.word_counts_py(body or b""):
                    docs.append(doc)
                    counts.append((np.fromiter(map(words.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))))
                    held += len(c)
                if held > HELD:
                    yield coded(docs, counts, words.terms)
                    docs, counts, held = [], [], 0
            if docs:
                yield coded(docs, counts, words.terms)

    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded blocks out of parts of them that follow each other, also from one batch to the next."""

    def merged(b: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, at in _parts(b, starts) if len(starts) else ():
            row, inside, tf = _postings(part)
            group = np.repeat(np.arange(len(at)), np.diff(at, append=part.num_rows))[row]
            order = np.argsort(group * BLOCK + inside, kind="stable")
            n, code = _coded(group[order], inside[order], tf[order])
            yield pa.record_batch({"term": part.column("term").take(pa.array(at)), "block": part.column("block").take(pa.array(at)), "n": pa.array(n.astype(np.int32)), "code": code})

    held = None
    for b in batches:
        if held is not None:
            b = pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        term, block = b.column("term").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy()
        starts = np.flatnonzero(np.diff(term, prepend=-1).astype(bool) | np.diff(block, prepend=block[0]).astype(bool))
        yield from merged(b.slice(0, starts[-1]), starts[:-1])
        held = b.slice(starts[-1])
    if held is not None:
        yield from merged(held, np.array([0]))


def encoded_texts(docs: DataFrame, stemming: bool = True, body: str = "text") -> DataFrame:
    """:func:`encoded_postings` of the postings of documents ``(doc_id, body)``. Workers count, stem and
    code the documents of a batch; what is shuffled are codes of parts of blocks, which are merged."""
    parts = docs.select("doc_id", F.col(body).alias("body")).mapInArrow(_code_texts(stemming), CODED)
    return parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merge_blocks, CODED)


def decoded_postings(blocks: DataFrame) -> DataFrame:
    """Postings out of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _ in _parts(b, np.arange(b.num_rows)) if b.num_rows else ():
                row, inside, tf = _postings(part)
                doc = part.column("block").to_numpy()[row] * BLOCK + inside
                yield pa.record_batch({"term": part.column("term").take(pa.array(row)), "doc_id": pa.array(doc), "tf": pa.array(tf)})

    return blocks.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CODED.split(", "))).mapInArrow(run, "term string, doc_id long, tf long")


def posting_deltas(p: DataFrame) -> DataFrame:
    """Each posting with its distance from the one before it in its list. Frequent terms make long
    lists, so lists are cut by blocks of document ids; a block starts from the end of the one before.
    Blocks are sorted once: the first posting of each carries the block's end over to the next one's."""
    b = p.select("term", "doc_id", "tf", F.floor(F.col("doc_id") / BLOCK).alias("blk"))
    inside = b.select("*", F.expr("lag(doc_id) OVER (PARTITION BY term, blk ORDER BY doc_id)").alias("near"))
    ends = b.groupBy("term", "blk").agg(F.max("doc_id").alias("hi"))
    before = ends.select("term", "blk", F.expr("lag(hi) OVER (PARTITION BY term ORDER BY blk)").alias("prev")).where("prev IS NOT NULL")
    j = inside.join(before, ["term", "blk"], "left")
    return j.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("near", "prev", F.lit(0))).alias("delta"))


def index_size(p: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of a packed file of the index, plain and with coded postings: a header of 64, two slots
    of 20 per term, 20 per document, the strings with an end byte each, 8 per posting or its code."""
    sized = posting_deltas(p).select("term", (codec.size_of(F.col("delta")) + codec.size_of(F.col("tf"))).alias("b"))
    per_term = sized.groupBy("term").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    t = per_term.agg(
        F.count("*").alias("terms"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("postings"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("coded"),
        F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0)).alias("term_bytes"),
    )
    strings = F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit(""))) + 2
    d = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(strings), F.lit(0)).alias("doc_bytes"))
    fixed = F.lit(64) + 20 * F.greatest(F.lit(2), 2 * F.col("terms")) + 20 * F.col("docs") + F.col("term_bytes") + F.col("doc_bytes")
    one = t.join(F.broadcast(d))  # one row each
    return one.select((fixed + 8 * F.col("postings")).cast("long").alias("plain_bytes"), (fixed + F.col("coded")).cast("long").alias("coded_bytes"))


SCHEMAS = {
    "postings": "term string, doc_id long, tf long, doc_len long",
    "terms": "term string, df long, cf long",
    "docs": "doc_id long, title string, url string, total_tokens long",
    "meta": "version int, num_docs long, num_terms long, num_postings long, stemming boolean",
}


@dataclass
class Index:
    """The index's tables: ``postings(term, doc_id, tf, doc_len)``, ``terms(term, df, cf)``,
    ``docs(doc_id, title, url, total_tokens)`` and ``meta`` of one row."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    meta: DataFrame
    stemming: bool = True
    path: str | None = None
    _size: int | None = None
    _counts: DataFrame | None = None

    @property
    def num_docs(self) -> int:
        if self._size is None:
            self._size = self.meta.first().num_docs
        return self._size

    @staticmethod
    def of(docs: DataFrame, title: Column | None = None, url: Column | None = None, stemming: bool = True, body: str = "text") -> Index:
        """Index of documents ``(doc_id, body)``, lazily; ids must be unique. Every document counts
        in the size of the collection, whether it has tokens or not."""
        none = F.lit(None).cast("string")
        counts = token_counts(docs, body)
        p = stemmed(counts) if stemming else counts.withColumnRenamed("token", "term")
        d = forward(docs, none if title is None else title, none if url is None else url, body)
        t = term_table(p)
        p = p.join(d.select("doc_id", F.col("total_tokens").alias("doc_len")), "doc_id")
        num = t.agg(F.count("*").alias("num_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("num_postings"))
        meta = d.agg(F.count("*").alias("num_docs")).join(F.broadcast(num)).select(F.lit(VERSION).alias("version"), "*", F.lit(stemming).alias("stemming"))
        return Index(p, t, d, meta, stemming, _counts=counts)

    def write(self, path: str, compress: bool = False) -> Index:
        """Writes the tables, the meta row last, and reads them back. Texts are tokenized once for the
        documents and once for the postings. Postings are sorted by term and document over the whole
        table, so that a query for a term reads few row groups. With ``compress``, the posting blocks
        are written in variable bytes besides, in ``coded``."""
        spark = self.postings.sparkSession

        def put(name: str, df: DataFrame, *order: str) -> DataFrame:
            df = df.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]})" for c in SCHEMAS[name].split(", ")])
            if order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            w = df.write.mode("overwrite")
            (w.option("parquet.bloom.filter.enabled#term", "true") if "term" in order else w).parquet(f"{path}/{name}")
            return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")

        d = put("docs", self.docs, "doc_id")
        p = self.postings
        if self._counts is not None:
            counts = keep(self._counts)
            p = stemmed(counts) if self.stemming else counts.withColumnRenamed("token", "term")
            p = p.join(d.select("doc_id", F.col("total_tokens").alias("doc_len")), "doc_id")
        p = put("postings", p, "term", "doc_id")
        t = put("terms", term_table(p), "term")
        if compress:
            encoded_postings(p).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/coded")
        num = t.agg(F.count("*").alias("num_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("num_postings"))
        meta = d.agg(F.count("*").alias("num_docs")).join(F.broadcast(num))
        put("meta", meta.select(F.lit(VERSION).alias("version"), "*", F.lit(self.stemming).alias("stemming")))
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """The index under ``path``. Of its tables the meta row alone is read now."""
        t = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()}
        meta = t["meta"].first()
        if meta is None or meta.version != VERSION:
            raise ValueError(f"the index has version {meta and meta.version}, not {VERSION}")
        return Index(**t, stemming=meta.stemming, path=path, _size=meta.num_docs)

    def coded(self) -> DataFrame:
        """The posting blocks in variable bytes, of an index written with ``compress``."""
        return self.postings.sparkSession.read.parquet(f"{self.path}/coded")

    def bytes_stored(self) -> dict[str, int]:
        """Bytes of each table's files."""
        spark = self.postings.sparkSession
        return {n: sum(size for _, size, _ in files(spark, f"{self.path}/{n}")) for n in (*SCHEMAS, "coded")}

    def close(self) -> None:
        """Deletes an index that was made for this session; one at a place of its own stays."""
        if self.path and self.path.startswith(f"{checkpoint_dir(self.meta.sparkSession).rstrip('/')}/index-"):
            spark = self.meta.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _OPEN.pop((spark.sparkContext.applicationId, self.path), None)


_OPEN: dict[tuple[str, str], Index] = {}


def stored_index(spark: SparkSession, source: str, build: Callable[[], Index], name: str = "", anew: bool = False) -> Index:
    """The index of the table under ``source``, built once for each version of its files and opened
    from then on. It lies in the shared folder, complete or not at all. ``name`` tells indexes of
    one table apart; with ``anew`` it is built in any case, beside the one that may be there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/index-{name}{version(spark, source)}"
    at = spark.sparkContext.applicationId, path
    there = at in _OPEN or bool(files(spark, f"{path}/meta"))
    if anew or not there:
        made = f"{path}-{uuid.uuid4().hex}"
        index = build().write(made)
        if there:
            return index
        publish(spark, made, path)
    if at not in _OPEN:
        _OPEN[at] = Index.open(spark, path)
    return _OPEN[at]

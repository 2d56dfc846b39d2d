"""Frequency of every term, and how distinctive a term is of a record.

``term_frequency`` keeps last-seen counters: tokens are hash-partitioned and ordered by record,
and each term stores its occurrences, its records and the record it was last seen in, so that no
set of records is ever kept. A partition holds whole records (very long ones are dealt with apart),
so the counters of several partitions add up.

``distinctiveness`` is positive pointwise mutual information of term and record, made of
group-bys and joins only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, keep

#: The characters of Unicode's White_Space and the information separators.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: A record with a slot at or above this is split over partitions and counted apart.
LONG_RECORD = 1 << 16
#: So many long records are sent to every executor, more are joined.
FEW_LONG = 50_000
#: A partition hands on its counters at the next record when it holds so many terms.
VOCABULARY = 400_000


def normal_term(term: Column) -> Column:
    """Term without surrounding white space, in lower case and composed (NFC); null if nothing is left."""
    t = F.lower(F.btrim(term, F.lit(WHITE)))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(t, F.lit("")), F.lit(False))
    t = F.when(F.octet_length(t) == F.char_length(t), t).otherwise(composed)
    return F.when(t != "", t)


#: Tables of up to so many rows (terms, records) are sent to every executor.
SENT = 500_000

_PARTIAL = "term string, record long, occurrences long, records long"


def _last_seen(batches: Iterator[pa.RecordBatch], whole: bool = True, limit: int = VOCABULARY) -> Iterator[pa.RecordBatch]:
    """Counters of a partition ordered by (record, slot). Of the rows with one record and slot the
    last counts; rows without slot all count. The row without term and record holds the number of
    records; where partitions split records (not ``whole``), each record has a row without term."""
    code: dict[str, int] = {}
    occ = np.zeros(1024, np.int64)
    rec = np.zeros(1024, np.int64)
    last = np.full(1024, np.iinfo(np.int64).min, np.int64)
    of_long: dict[tuple[int, int], int] = {}
    long_records: set[int] = set()
    seen: list[np.ndarray] = []
    n_records, current = 0, None
    held: pa.RecordBatch | None = None

    def emit() -> pa.RecordBatch:
        names = list(code)
        k = len(names)
        # counters of terms, then terms of long records, then records, each of which counts once
        alone = np.unique(np.concatenate([*seen, np.array(list(long_records), np.int64)]))
        term = [*names, *(names[c] for c, _ in of_long), None, *([None] * len(alone))]
        table = pa.record_batch(
            {
                "term": pa.array(term, pa.string()),
                "record": pa.array([None] * k + [r for _, r in of_long] + [None] + alone.tolist(), pa.int64()),
                "occurrences": pa.array([*occ[:k].tolist(), *of_long.values(), 0, *([0] * len(alone))], pa.int64()),
                "records": pa.array([*rec[:k].tolist(), *([1] * len(of_long)), n_records, *([1] * len(alone))], pa.int64()),
            }
        )
        return table.filter(pa.array(np.concatenate([rec[:k] > 0, np.ones(len(term) - k, bool)])))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal held
        for b in it:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            held = b.slice(b.num_rows - 1)
            yield b
        if held is not None:
            rest, held = held, None
            yield rest

    for b in rows(batches):
        n = b.num_rows if held is None else b.num_rows - 1
        if not n:
            continue
        record = b.column("record").to_numpy(zero_copy_only=False)
        slot = b.column("slot").fill_null(-1).to_numpy(zero_copy_only=False)
        keep = np.ones(n, bool)
        m = min(n, b.num_rows - 1)
        keep[:m] = (record[:m] != record[1 : m + 1]) | (slot[:m] != slot[1 : m + 1]) | (slot[:m] < 0)
        record = record[:n]
        if len(code) > limit and current is not None and record[0] != current:
            yield emit()
            code.clear(), of_long.clear(), long_records.clear(), seen.clear()
            occ[:], rec[:], last[:], n_records, current = 0, 0, np.iinfo(np.int64).min, 0, None
        d = b.column("term").slice(0, n).dictionary_encode()
        to = np.fromiter((code.setdefault(t, len(code)) for t in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
        if len(code) > len(occ):
            more = max(len(code), 2 * len(occ)) - len(occ)
            occ, rec = np.pad(occ, (0, more)), np.pad(rec, (0, more))
            last = np.pad(last, (0, more), constant_values=np.iinfo(np.int64).min)
        codes = to[d.indices.to_numpy(zero_copy_only=False)]
        weight = b.column("n").slice(0, n).to_numpy(zero_copy_only=False)
        is_long = b.column("long").slice(0, n).to_numpy(zero_copy_only=False)
        if is_long.any():
            for c, r, w in zip(*(x[keep & is_long].tolist() for x in (codes, record, weight)), strict=True):
                of_long[c, r] = of_long.get((c, r), 0) + w
                long_records.add(r)
            keep &= ~is_long
        codes, record, weight = codes[keep], record[keep], weight[keep]
        if not len(codes):
            continue
        np.add.at(occ, codes, weight)
        starts = np.flatnonzero(np.diff(record)) + 1
        if whole:
            n_records += len(starts) + (record[0] != current)
        else:
            seen.append(record[np.concatenate([[0], starts])])
        current = record[-1]
        index = np.zeros(len(record), np.int64)
        index[starts] = 1
        index = np.cumsum(index)
        pair = np.unique(codes * (index[-1] + 1) + index)
        c, i = np.divmod(pair, index[-1] + 1)
        seen_in = record[np.concatenate([[0], starts])][i]
        fresh = seen_in != last[c]
        np.add.at(rec, c[fresh], 1)
        last[c] = seen_in  # pairs are in order: the last record of each term stays
    yield emit()


def term_counters(rows: DataFrame, whole: bool = True) -> DataFrame:
    """``(term, occurrences, records)`` of rows ``(record, slot, term, n, long)`` in this order; the row with a null
    term has the number of records. Rows are partitioned by record (and part of a long record), or
    in any other way that keeps the rows of a term and record together if not ``whole``."""
    parts = rows.mapInArrow(partial(_last_seen, whole=whole), _PARTIAL)
    # what partitions share is a term of one record, or a record: each counts once
    once = parts.groupBy("term", "record").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    n = F.when(F.col("record").isNull(), F.col("records")).otherwise(1)
    return once.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(n).alias("records"))


def token_rows(tokens: DataFrame, record: str = "doc_id", slot: str = "position", term: str = "text") -> DataFrame:
    """Rows for :func:`term_counters` out of one row per token. Of rows with the same record and slot
    one counts (the greatest term, should they differ). Rows with null record or slot, null and blank terms don't count."""
    t = tokens.select(
        F.col(record).cast("long").alias("record"), F.col(slot).cast("int").alias("slot"), normal_term(F.col(term)).alias("term")
    ).dropna()
    long = tokens.where(F.col(slot) >= LONG_RECORD).select(F.col(record).cast("long").alias("record"), F.lit(True).alias("long")).distinct()
    n_long = long.limit(FEW_LONG + 1).count()  # reads the slots only, and of these what the statistics leave
    if n_long:
        t = t.join(F.broadcast(long) if n_long <= FEW_LONG else long, "record", "left").fillna(False, "long")
        t = t.repartition("record", F.when(F.col("long"), F.floor(F.col("slot") / LONG_RECORD)))
    else:
        t = t.repartition("record").withColumn("long", F.lit(False))
    return t.sortWithinPartitions("record", "slot", "term").select("record", "slot", "term", F.lit(1).alias("n"), "long")


def counted_postings(postings: DataFrame, record: str = "doc_id", term: str = "term", tf: str = "tf", loaded: str = "loaded_at", by: Sequence[str] = ("term", "record"), long: DataFrame | None = None) -> DataFrame:
    """``(term, record, tf)``, one row for each term and record with tf of 1 or more. Of rows that
    agree in both the newest decides, of equally new ones the greatest tf; null times are oldest.
    Rows are partitioned ``by`` term and record or one of them, and those of ``long`` records, which then
    are marked in the column ``long``, by their terms too."""
    p = postings.select(
        normal_term(F.col(term)).alias("term"),
        F.col(record).cast("long").alias("record"),
        F.unix_micros(loaded).alias("at"),
        F.greatest(F.coalesce(F.col(tf), F.lit(0)), F.lit(0)).cast("long").alias("tf"),
    ).dropna(subset=["term", "record"])
    # time and tf in one number, whose maximum is aggregated in place, as a struct's is not
    r = postings.agg(F.min(F.unix_micros(loaded)), F.max(F.unix_micros(loaded)), F.max(tf)).first()
    first, span = r[0] or 0, (r[1] or 0) - (r[0] or 0) + 2
    unit = max(r[2] or 0, 1) + 1
    at = F.coalesce(F.col("at") - F.lit(first) + 1, F.lit(0))
    if span * unit < 1 << 62:
        packed = at * F.lit(unit) + F.col("tf")
    else:
        packed = at.cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)") + F.col("tf").cast("decimal(10,0)")
    p, split = p.select("term", "record", packed.alias("p")), []
    if long is not None:
        p = p.join(long, "record", "left").fillna(False, "long")
        p, split = p.withColumn("part", F.when(F.col("long"), F.pmod(F.xxhash64("term"), F.lit(64)))), ["part", "long"]
    p = p.repartition(*by, *split[:1]).groupBy("term", "record", *split).agg(F.max("p").alias("p"))
    return p.select("term", "record", *split[1:], F.pmod(F.col("p"), F.lit(unit)).cast("int").alias("tf")).where("tf >= 1")


def posting_rows(postings: DataFrame, record: str = "doc_id", **names: str) -> DataFrame:
    """Rows for :func:`term_counters` out of postings, partitioned by record, so that each record is
    counted in one place. A record of LONG_RECORD rows or more is split by its terms and counted apart."""
    of = postings.groupBy(F.col(record).cast("long").alias("record")).agg(F.count("*").alias("n"))
    long = cut(of.where(F.col("n") >= LONG_RECORD).select("record", F.lit(True).alias("long")))  # reads the record's column only
    n_long = long.limit(FEW_LONG + 1).count()
    if n_long:
        c = counted_postings(postings, record, by=["record"], long=F.broadcast(long) if n_long <= FEW_LONG else long, **names)
    else:
        c = counted_postings(postings, record, by=["record"], **names).withColumn("long", F.lit(False))
    return c.sortWithinPartitions("record").select("record", F.lit(None).cast("int").alias("slot"), "term", F.col("tf").alias("n"), "long")


def term_frequency(sources: dict[str, tuple[DataFrame, bool]], rare_records: int = 3, rare_occurrences: int = 5, common_share: float = 0.3) -> DataFrame:
    """``(origin, term, occurrences, records, mark)`` of every distinct term of each source, which is
    given by its rows and whether their partitions hold whole records.

    ``mark`` is ``rare`` for a term in fewer than ``rare_records`` records or with fewer than
    ``rare_occurrences`` occurrences, else ``common`` for one in more than ``common_share`` of the
    records that have any term, else null. An empty source has no terms.
    """
    out = None
    for origin, (rows, whole) in sources.items():
        counted = term_counters(rows, whole).select(F.lit(origin).alias("origin"), "*")
        out = counted if out is None else out.unionByName(counted)
    out = cut(out)
    total = out.where(F.col("term").isNull()).select("origin", F.col("records").alias("_all"))  # a row per source
    terms = out.where(F.col("term").isNotNull()).join(F.broadcast(total), "origin")
    rare = (F.col("records") < rare_records) | (F.col("occurrences") < rare_occurrences)
    mark = F.when(rare, "rare").when(F.col("records") > F.lit(common_share) * F.col("_all"), "common")
    return terms.select("origin", "term", "occurrences", "records", mark.alias("mark"))


def record_lengths(counted: DataFrame, forward: DataFrame, record: str = "doc_id") -> DataFrame:
    """``(record, total, length)``: the sum of the record's tf, and the newest ``doc_total_tokens`` (of
    equally new ones the greatest) or, if that is null or below 1 or the record has no entry, the sum."""
    f = forward.groupBy(F.col(record).cast("long").alias("record")).agg(F.max(F.struct("loaded_at", "doc_total_tokens")).alias("f"))
    sums = counted.groupBy("record").agg(F.sum("tf").alias("total"))
    n = F.col("f.doc_total_tokens")
    return sums.join(f, "record", "left").select("record", "total", F.when(n >= 1, n).otherwise(F.col("total")).alias("length"))


def collection_size(headers: DataFrame) -> DataFrame:
    """One row ``n``: ``num_docs`` summed over the segments, each by its newest ``built_at``."""
    h = headers.groupBy("segment_id").agg(F.max(F.struct("built_at", "num_docs")).alias("h"))
    return h.agg(F.sum("h.num_docs").alias("n"))


def distinctiveness(postings: DataFrame, forward: DataFrame, headers: DataFrame, alpha: float = 0.75) -> DataFrame:
    """``(record, term, tf, length, df, expected, idf, ppmi, weight)`` of each term of each record.

    ``ppmi`` is the positive part of ln(p(term, record) / (p(term) p_a(record))), all from the joint
    counts tf: the record is the context, whose marginal, the sum of its tf, is raised to ``alpha``
    and normalised again, so that short records don't outweigh all others. ``expected`` is
    the tf that a ppmi of 0 amounts to, p(term) p_a(record) times the sum of all tf. ``weight`` is
    tf / length * ln(n / df), 0 if n or df is 0. Nothing is dropped: terms with a ppmi of 0 come out
    too. Empty postings give no rows.
    """
    counted = keep(counted_postings(postings))
    records = keep(record_lengths(counted, forward).withColumn("smooth", F.pow("total", F.lit(alpha))))
    terms = keep(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    # five numbers for the whole collection
    of_records = records.agg(F.sum("smooth").alias("mass"), F.count("*").alias("n")).first()
    n_terms, n = terms.count(), collection_size(headers).first()[0] or 0
    idf = F.when((F.col("df") > 0) & (F.lit(n) > 0), F.log(F.lit(float(n)) / F.col("df"))).otherwise(F.lit(0.0))
    terms = terms.select("term", "df", "cf", idf.alias("idf"))
    records = records.select("record", "length", (F.col("smooth") / F.lit(float(of_records.mass or 1.0))).alias("p_record"))
    # both sides have been counted: they are sent to every executor up to a bound, joined beyond it
    rows = counted.join(F.broadcast(records) if of_records.n <= SENT else records, "record")
    rows = rows.join(F.broadcast(terms) if n_terms <= SENT else terms, "term")
    # cf / N * p_record * N: the sum of all tf cancels out
    rows = rows.withColumn("expected", F.col("cf") * F.col("p_record"))
    pmi = F.log(F.col("tf") / F.col("expected"))
    weight = F.col("tf") / F.col("length") * F.col("idf")
    return rows.select("record", "term", "tf", "length", "df", "expected", "idf", F.greatest(pmi, F.lit(0.0)).alias("ppmi"), weight.alias("weight"))


def distinctive_terms(scored: DataFrame, least: float) -> DataFrame:
    """The rows with a weight of at least ``least``: candidates by ppmi, then the exact test.

    A term is a candidate where its ppmi is positive, that is where tf exceeds ``expected``. Where it
    doesn't, the weight is at most expected / length * idf; terms for which that reaches ``least``
    are candidates too, so that no case is lost.
    """
    candidate = (F.col("ppmi") > 0) | (F.col("expected") / F.col("length") * F.col("idf") >= least)
    return scored.where(candidate & (F.col("weight") >= least))

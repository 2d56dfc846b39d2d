"""Filling containers of fixed capacity by bulk-synchronous best fit.

In each round the items not yet placed and the gaps of the containers are range-sorted together by
size. A sweep upwards over every range gives each gap the largest item before it that is still free,
which is its best fit, and goes on with what is left of the gap as long as the next item fits. What a
range can't match by itself, items whose gaps lie in later ranges, is matched across ranges by rank,
from counts of each range alone; there a gap has as many places as the largest free item fits into
it. The gaps are then updated, and the next round begins. When no item fits any gap, new containers
are opened, as many as the remaining items need by volume. Nothing but counts by range comes to the
driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, slots

#: What a row is: an item or a gap that is free, a gap after an item went in, an item placed, counts of a range.
ITEM, GAP, CHANGED, PLACED, COUNTS = range(5)

_STATE = ("limit_id", "value", "kind", "id", "part")
_SWEPT = "limit_id int, range int, what int, rank long, id string, part int, value long, places long, container string, least long, most long, top long"
_DEALT = "limit_id int, what int, id string, part int, value long, container string"
_BATCH = 50_000


class _Rows:
    """Rows of a schema, handed on in record batches."""

    def __init__(self, schema: str):
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        self.schema = pa.schema([(n, kinds[k]) for n, k in map(str.split, schema.split(", "))])
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows = []
        return out


def _sweep(largest: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweeps one range, rows ordered as _STATE. Free rows come out with their rank from the bottom
    of the range: items by number, gaps by places. ``largest`` bounds the free items of each limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, out = TaskContext.get().partitionId(), _Rows(_SWEPT)
        limit, free, rank, most = None, [], 0, 0

        def finish() -> None:
            if limit is None:
                return
            for k, (i, p, v) in enumerate(free):
                out.rows.append((limit, here, ITEM, k, i, p, v, 1, None, None, None, None))
            sizes = (free[0][2], free[-1][2]) if free else (None, None)
            out.rows.append((limit, here, COUNTS, len(free), None, None, sum(x[2] for x in free), rank, None, sizes[0], most, sizes[1]))

        for b in batches:
            for lim, v, kind, i, p in zip(*(b.column(c).to_pylist() for c in _STATE), strict=True):
                if lim != limit:
                    finish()
                    limit, free, rank, most = lim, [], 0, 0
                if kind == ITEM:
                    free.append((i, p, v))
                elif free:
                    while free and free[-1][2] <= v:
                        item, part, size = free.pop()
                        v -= size
                        out.rows.append((lim, here, PLACED, None, item, part, size, None, i, None, None, None))
                    if v:
                        most = max(most, v)
                        out.rows.append((lim, here, CHANGED, None, i, p, v, None, None, None, None, None))
                else:
                    n = max(1, v // largest.get(lim, v))
                    most = max(most, v)
                    out.rows.append((lim, here, GAP, rank, i, p, v, n, None, None, None, None))
                    rank += n
            if len(out.rows) >= _BATCH:
                yield out.batch()
        finish()
        yield out.batch()

    return run


def _across(counts: list) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of what the ranges left, as segments ``(limit_id, kind, part, from rank, to rank,
    offset)``; rows of either kind whose rank and offset give the same number are a match. Free
    items of lower ranges are taken from the top by the gaps of the next range, least gap first."""
    by: dict[int, dict[int, dict[int, int]]] = {}
    for limit, part, kind, n in counts:
        by.setdefault(limit, {}).setdefault(part, {})[kind] = n
    out, number = [], 0
    for limit, parts in by.items():
        stack: list[list[int]] = []
        for part in sorted(parts):
            gaps, taken = parts[part].get(1, 0), 0
            while taken < gaps and stack:
                below, n = stack[-1]
                k = min(n, gaps - taken)
                # items n-k..n-1 go to gaps taken..taken+k-1, in order of size on both sides
                out.append((limit, 0, below, n - k, n, number - (n - k)))
                out.append((limit, 1, part, taken, taken + k, number - taken))
                number += k
                taken += k
                stack[-1][1] -= k
                if not stack[-1][1]:
                    stack.pop()
            if parts[part].get(0):
                stack.append([part, parts[part][0]])
    return out


def _segments(matches: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches with the gaps of a range, whose numbers go on from one segment to the next, as one segment."""
    gaps: dict[tuple[int, int], tuple[int, int]] = {}
    for limit, kind, at, _, high, offset in matches:
        if kind == GAP:
            gaps[limit, at] = high, offset
    return [m for m in matches if m[1] == ITEM] + [(limit, GAP, at, 0, high, offset) for (limit, at), (high, offset) in gaps.items()]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts numbered items into the gaps that hold their numbers, rows ordered by (chunk, number, gap
    first). An item whose gap begins in another chunk stays free."""
    out, chunk, gap, until = _Rows(_DEALT), None, None, -1

    def finish() -> None:
        if gap and gap[3]:
            out.rows.append((gap[0], GAP, gap[1], gap[2], gap[3], None))

    for b in batches:
        for c, number, what, lim, i, p, v, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "number", "what", "limit_id", "id", "part", "value", "places")), strict=True):
            if c != chunk or what == GAP:
                finish()
                chunk, gap = c, None
            if what == GAP:
                gap, until = [lim, i, p, v], number + n
            elif gap and number < until:
                gap[3] -= v
                out.rows.append((lim, PLACED, i, p, v, gap[1]))
            else:
                out.rows.append((lim, ITEM, i, p, v, None))
        if len(out.rows) >= _BATCH:
            yield out.batch()
    finish()
    yield out.batch()


def pieces(items: DataFrame, limits: DataFrame, item: str = "id", size: str = "size") -> DataFrame:
    """``(limit_id, capacity, item, part, size)``: each item for each limit; one above the capacity
    is split into full pieces and a rest."""
    both = items.join(F.broadcast(limits), items["limit_key"] == limits["limit_key"]).select("limit_id", "capacity", F.col(item).alias("item"), F.col(size).cast("long").alias("size"))
    n = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int")
    split = both.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return split.select("limit_id", "capacity", "item", "part", F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")).alias("size"))


def pack(items: DataFrame, limits: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(limit_id, container, item, part, size)``: the container of each piece of each item.

    ``items`` has ``id``, ``size`` and ``limit_key``, ``limits`` has ``limit_id``, ``capacity`` and
    ``limit_key``; the limits are a table of parameters and are broadcast. Only an item above the
    capacity is split. Items with a null or zero size take no room and go to container ``e`` of
    their limit. Limits with a null or non-positive capacity take nothing. Repeated ids are packed
    as one item of the largest size.
    """
    spark = items.sparkSession
    limits = limits.where("capacity > 0").select("limit_id", "capacity", "limit_key").distinct()
    capacities = {r.limit_id: r.capacity for r in limits.collect()}
    items = items.where(F.col("id").isNotNull()).groupBy("id", "limit_key").agg(F.max(F.coalesce("size", F.lit(0))).alias("size"))
    named = cut(pieces(items, limits).select("limit_id", "capacity", F.col("item").cast("string").alias("id"), "part", F.col("size").alias("value")))
    placed = [
        # what fills a container by itself needs no search
        named.where("value = capacity").select("limit_id", F.concat(F.lit("w"), "id", F.lit("."), "part").alias("container"), "id", "part", "value"),
        named.where("value <= 0").select("limit_id", F.lit("e").alias("container"), "id", "part", "value"),
    ]
    left = named.where("value > 0 AND value < capacity").select("limit_id", "value", F.lit(ITEM).alias("kind"), "id", "part")
    parts: list[DataFrame] = [left]
    to_open, largest = {}, {}
    for limit, volume, top in left.groupBy("limit_id").agg(F.sum("value"), F.max("value")).collect():
        to_open[limit], largest[limit] = -(-volume // capacities[limit]), top
    opened: dict[int, int] = {}
    for _ in range(max_rounds):
        if not largest:
            break
        for limit, n in to_open.items():
            first = opened.get(limit, 0)
            opened[limit] = first + n
            name = F.concat(F.lit("c"), "id").alias("id")
            parts.append(spark.range(first, first + n).select(F.lit(limit).alias("limit_id"), F.lit(capacities[limit]).cast("long").alias("value"), F.lit(GAP).alias("kind"), name, F.lit(-1).alias("part")))
        state = parts[0]
        for p in parts[1:]:
            state = state.unionByName(p)
        swept = cut(state.repartitionByRange(*_STATE).sortWithinPartitions(*_STATE).mapInArrow(_sweep(largest), _SWEPT))
        counts = swept.where(F.col("what") == COUNTS).select("limit_id", "range", "rank", "places", "least", "most", "top", "value").collect()
        placed.append(swept.where(F.col("what") == PLACED).select("limit_id", "container", "id", "part", "value"))
        least = {c.limit_id: min(x.least for x in counts if x.limit_id == c.limit_id and x.least) for c in counts if c.least}
        largest = {c.limit_id: max(x.top for x in counts if x.limit_id == c.limit_id and x.top) for c in counts if c.top}
        # a gap below the least free item is full
        useful = F.coalesce(F.try_element_at(_map(least), F.col("limit_id")), F.lit(1 << 62))
        free = swept.where((F.col("what") <= GAP) & ((F.col("what") == ITEM) | (F.col("value") >= useful)))
        changed = swept.where((F.col("what") == CHANGED) & (F.col("value") >= useful)).select("limit_id", "value", F.lit(GAP).alias("kind"), "id", "part")
        segments = _segments(_across([(c.limit_id, c.range, k, n) for c in counts for k, n in ((ITEM, c.rank), (GAP, c.places))]))
        as_state = ("limit_id", "value", F.col("what").alias("kind"), "id", "part")
        if segments:
            names = ("limit_id", "what", "range", "low", "high", "shift")
            s = F.broadcast(spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*segments, strict=True), strict=True)})))
            on = (free.limit_id == s.limit_id) & (free.what == s.what) & (free.range == s.range) & (free["rank"] >= s.low) & (free["rank"] < s.high)
            matched = sum(x[4] - x[3] for x in segments if x[1] == ITEM)
            number, size = free["rank"] + s["shift"], max(1000, -(-matched // slots(spark)))
            places = F.least(free.places, s.high - free["rank"])
            met = free.join(s, on).select(F.floor(number / size).alias("chunk"), number.alias("number"), free.what, free.limit_id, "id", "part", "value", places.alias("places"))
            dealt = cut(met.repartition("chunk").sortWithinPartitions("chunk", "number", F.desc("what")).mapInArrow(_deal, _DEALT))
            placed.append(dealt.where(F.col("what") == PLACED).select("limit_id", "container", "id", "part", "value"))
            if matched == sum(c.rank for c in counts) and dealt.where(F.col("what") == ITEM).isEmpty():
                break
            parts = [free.join(s, on, "left_anti").select(*as_state), dealt.where(F.col("what") <= GAP).select(*as_state), changed]
        else:
            parts = [free.select(*as_state), changed]
        to_open = {}
        for limit in largest.keys() - {x[0] for x in segments}:
            of = [c for c in counts if c.limit_id == limit]
            if max(c.most for c in of) < least[limit]:
                to_open[limit] = -(-sum(c.value for c in of) // capacities[limit])
    else:
        raise RuntimeError("the items were not placed within max_rounds")
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return where.select("limit_id", "container", F.col("id").alias("item"), "part", F.col("value").alias("size"))


def _map(of: dict[int, int]):
    if not of:
        return F.create_map().cast("map<int,bigint>")
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k).cast("int"), F.lit(v).cast("long"))])


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """For each limit: containers used, what they hold, and the share of their room that is used."""
    used = packed.where("size > 0").groupBy("limit_id").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("held"))
    return used.join(F.broadcast(limits.select("limit_id", "capacity")), "limit_id").select(
        "limit_id", "capacity", "containers", "held", (F.col("held") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )

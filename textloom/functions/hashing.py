"""MurmurHash3, the public 32-bit variant for x86, over the bytes of a string."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the public algorithm.
C1, C2 = 0xCC9E2D51, 0x1B873593
MASK = 0xFFFFFFFF


def _mixed(k: int) -> int:
    k = k * C1 & MASK
    return (k << 15 | k >> 17) * C2 & MASK


def murmur3_32(data: bytes, seed: int = 42) -> int:
    h, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= _mixed(int.from_bytes(data[at : at + 4], "little"))
        h = (h << 13 | h >> 19) & MASK
        h = h * 5 + 0xE6546B64 & MASK
    if whole < len(data):
        h ^= _mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & MASK
    return h


def murmur3(text: Column, seed: int = 42) -> Column:
    """The hash as a non-negative number; null for null. Meant for distinct words."""

    @F.arrow_udf("bigint")
    def hashes(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([None if x is None else murmur3_32(x, seed) for x in a.cast(pa.binary()).to_pylist()], pa.int64())

    return hashes(text)

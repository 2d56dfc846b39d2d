"""Delta and variable-byte codecs. Low seven bits first; a set high bit says that more follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes of non-negative integers below 2**35, and where each code ends."""
    v = np.asarray(values, np.int64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 5):
        n += v >= 1 << 7 * k
    ends = np.cumsum(n)
    starts = ends - n
    out = np.empty(ends[-1] if len(v) else 0, np.uint8)
    out[starts] = (v & 0x7F) | (n > 1) << 7
    for k in range(1, n.max(initial=1)):
        of = np.flatnonzero(n > k)
        out[starts[of] + k] = (v[of] >> 7 * k & 0x7F) | (n[of] > k + 1) << 7
    return out, ends


def encode_values(values: np.ndarray) -> bytes:
    """Variable-byte code of non-negative integers below 2**35, all at once."""
    return _coded(values)[0].tobytes()


def encode_runs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Codes of consecutive runs of values, each of at least one, as an array of binaries."""
    code, ends = _coded(values)
    offsets = np.concatenate([[0], ends[np.cumsum(sizes) - 1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(code)])


def decode_values(code: bytes | pa.Buffer) -> np.ndarray:
    b = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    n = ends - starts + 1
    v = (b[starts] & 0x7F).astype(np.int64)
    for k in range(1, n.max(initial=1)):
        of = np.flatnonzero(n > k)
        v[of] |= (b[starts[of] + k] & 0x7F).astype(np.int64) << 7 * k
    return v


def decode_runs(codes: pa.Array) -> np.ndarray:
    """The values of all codes of an array, one after the other."""
    offsets = np.frombuffer(codes.buffers()[1], np.int64 if pa.types.is_large_binary(codes.type) else np.int32)
    lo, hi = int(offsets[codes.offset]), int(offsets[codes.offset + len(codes)])
    return decode_values(codes.buffers()[2].slice(lo, hi - lo)) if hi > lo else np.array([], np.int64)


def deltas(values: Column) -> Column:
    """Differences of a sorted array, the first value being its own difference."""
    return F.transform(values, lambda v, i: v - F.coalesce(F.try_element_at(values, F.when(i > 0, i)), F.lit(0)))


def size_of(value: Column) -> Column:
    """Bytes of a value's code."""
    return F.when(value < 128, 1).when(value < 16384, 2).when(value < 2097152, 3).when(value < 268435456, 4).otherwise(5)


@F.pandas_udf(T.BinaryType())
def vbyte_encode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(encode_values, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def vbyte_decode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(decode_values, na_action="ignore")


@F.arrow_udf(T.ArrayType(T.LongType()))
def undo_deltas(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Running sums of arrays, of a whole batch at once."""
    for a in it:
        offsets = a.offsets.to_numpy()
        flat = a.flatten().to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(flat)])
        starts = offsets[:-1] - offsets[0]
        sizes = np.diff(offsets)
        yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(sums[1:] - np.repeat(sums[starts], sizes), pa.int64()), mask=a.is_null())

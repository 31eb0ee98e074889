"""Bloom-filter bit positions of keys: FNV-1a 64 and one mixed hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

# Fixed values of the stored filters' format.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MIX = 1791791791
MIX_SHIFT = 33
BITS_PER_KEY = 10
MIN_BITS = 64


def fnv1a(keys: pa.Array) -> np.ndarray:
    """FNV-1a 64 of every string, one byte position of all strings at a time."""
    a = keys.cast(pa.large_binary())
    ends = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    start, length = ends[:-1], np.diff(ends)
    h = np.full(len(a), FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-length, kind="stable")
    alive = len(order)
    with np.errstate(over="ignore"):
        for i in range(int(length.max(initial=0))):
            while alive and length[order[alive - 1]] <= i:
                alive -= 1
            at = order[:alive]
            h[at] = (h[at] ^ data[start[at] + i].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """The second hash, made from the first."""
    with np.errstate(over="ignore"):
        m = (h >> np.uint64(MIX_SHIFT)) ^ (h * np.uint64(MIX))
    m[m == 0] = MIX
    return m


@pandas_udf(ArrayType(LongType()))
def bloom_hashes(keys: pd.Series) -> pd.Series:
    """Both hashes as signed numbers; null for a null key."""
    a = pa.array(keys, type=pa.string())
    h = fnv1a(a.fill_null(""))
    both = np.stack([h.view(np.int64), mixed(h).view(np.int64)], axis=1)
    return pd.Series([None if k is None else v for k, v in zip(a.to_pylist(), both.tolist())])


def unsigned_mod(h: Column, m: Column) -> Column:
    """``h`` read as unsigned, modulo ``m``."""
    return F.pmod(F.shiftrightunsigned(h, 1) % m * 2 + h.bitwiseAND(F.lit(1)), m)


def filter_bits(n_keys: int) -> int:
    """Size of a filter for ``n_keys`` keys."""
    return max(max(n_keys, 1) * BITS_PER_KEY, MIN_BITS)

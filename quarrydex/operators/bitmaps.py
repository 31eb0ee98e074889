"""Packed posting lists (bitmaps over buckets of ids) and bit-sliced days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_postings(postings: DataFrame) -> DataFrame:
    """``term, bucket, bitmap``: one bitmap per term and bucket of 32,768 ids; repeats don't matter."""
    rows = postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("term", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bitmap"))


def count_all(packed: DataFrame, terms: list[str]) -> DataFrame:
    """``n``: records holding all of ``terms``. Buckets in which a term has no bitmap don't count."""
    wanted = list(dict.fromkeys(terms))
    both = packed.where(F.col("term").isin(wanted)).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("b"), F.count(F.lit(1)).alias("k"))
    return both.where(F.col("k") == len(wanted)).agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).alias("n"))


def count_any(packed: DataFrame, terms: list[str]) -> DataFrame:
    """``n``: records holding any of ``terms``."""
    any_ = packed.where(F.col("term").isin(terms)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("b"))
    return any_.agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).alias("n"))


def cardinalities(packed: DataFrame) -> DataFrame:
    """``term, n``: records per term."""
    return packed.groupBy("term").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def day_blocks(low: int, high: int, bits: int = 32) -> list[tuple[int, int]]:
    """The fewest aligned blocks ``(first, size)`` of powers of two that cover low..high exactly."""
    out = []
    while low <= high:
        size = low & -low or 1 << bits
        while size > high - low + 1:
            size >>= 1
        out.append((low, size))
        low += size
    return out


def sliced_range(day: Column, a: dt.date, b: dt.date, bits: int = 22) -> Column:
    """``day BETWEEN a AND b`` by bit planes: for each aligned block, its upper bits must match.

    Days count from the year 1, so that 22 planes reach past the year 9999.
    """
    origin = -dt.date(1970, 1, 1).toordinal() + 1
    low, high = sorted(((a - dt.date(1970, 1, 1)).days - origin, (b - dt.date(1970, 1, 1)).days - origin))
    n = (F.unix_date(day) - F.lit(origin)).cast("bigint")
    hit = F.lit(False)
    for first, size in day_blocks(low, high, bits):
        k = size.bit_length() - 1
        block = F.lit(True)
        for i in range(k, bits):
            block = block & (F.getbit(n, F.lit(i)) == (first >> i & 1))
        hit = hit | block
    return F.coalesce(hit, F.lit(False))

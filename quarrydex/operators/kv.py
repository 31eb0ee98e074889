"""Key/value merges: newest value wins, or union of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.operators.changefeed import live_rows, replay_changes


def newest_values(log: DataFrame) -> DataFrame:
    """``key, seq, value`` of live keys from puts ``key, value, seq``; a null value is a tombstone."""
    return live_rows(replay_changes(log, ["key"], "seq", ["value"], F.col("value").isNull())).select("key", "seq", "value")


def get_key(log: DataFrame, key: str) -> DataFrame:
    """:func:`newest_values` of one key: the filter reaches the scan, then one small aggregation, no sort."""
    mine = log.where((F.col("key") == key) & F.col("seq").isNotNull())
    # Of equal sequences a tombstone wins, then the larger value, as in a replay.
    last = F.max(F.struct(F.col("seq").alias("s"), F.col("value").isNull().alias("gone"), F.col("value").alias("v")))
    one = mine.groupBy("key").agg(last.alias("x"))
    return one.where(~F.col("x.gone")).select("key", F.col("x.s").alias("seq"), F.col("x.v").alias("value"))


def union_members(log: DataFrame, member: str = "member") -> DataFrame:
    """``key, member``: all members ever put, except those put before the key's last tombstone (a null member).

    Rows without key or seq are no puts. One aggregation per pair and one per key, both combined before the shuffle.
    """
    rows = log.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select("key", F.col(member).alias("member"), "seq")
    gone = rows.where(F.col("member").isNull()).groupBy("key").agg(F.max("seq").alias("gone"))
    pairs = rows.where(F.col("member").isNotNull()).groupBy("key", "member").agg(F.max("seq").alias("seq"))
    return pairs.join(gone, "key", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).select("key", "member")

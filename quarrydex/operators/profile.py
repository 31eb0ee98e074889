"""Per-key results when a few keys hold most rows (value-frequency compression).

Rows are first grouped by key *and* value, which splits a hot key over all its values
and lets map-side combining collapse repeats. Every per-key result is then derived from
the weighted values: row counts, exact distinct counts, modes and extremes by aggregates
that combine partially (a hot key sends one row per task), exact percentiles by running
weights over ranges of (key, value), so that no task ever holds all values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydex.session import ensure_checkpoint_dir


def compress_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, value, weight)``: one row per distinct pair; rows without key are left out.

    ``value`` may be null; its rows form a pair of their own, with a weight like any other.
    """
    return (
        df.select(key.alias("key"), value.alias("value"))
        .where(F.col("key").isNotNull())
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def profile_keys(pairs: DataFrame) -> DataFrame:
    """One row per key from :func:`compress_values`.

    ``n_rows`` all rows, ``n_null`` rows whose value is null, ``n_values`` distinct non-null
    values, ``mode`` the most frequent non-null value (of several, the smallest) and
    ``mode_weight``, ``min_value``, ``max_value``. A key with null values only has
    ``n_values`` 0 and nulls for mode and extremes. An empty input gives no rows.
    """
    known = F.col("value").isNotNull()
    # Of equal weights min() of (-weight, value) takes the smallest value.
    best = F.min(F.when(known, F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))
    return (
        pairs.groupBy("key")
        .agg(
            F.sum("weight").alias("n_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("weight"))), F.lit(0)).alias("n_null"),
            F.count("value").alias("n_values"),
            best.alias("best"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
        .select(
            "key", "n_rows", "n_null", "n_values",
            F.col("best.v").alias("mode"), (-F.col("best.w")).alias("mode_weight"),
            "min_value", "max_value",
        )
    )


def heavy_keys(df: DataFrame, key: Column, value: Column, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows with a key: ``key, n_rows, n_values, mode_weight``.

    ``share`` is read as a decimal fraction and compared exactly: rows / total >= share without
    rounding. The total is a count of its own, of the key column only: every task sends one number, and
    the pairs are shuffled once.
    """
    num, den = _fraction(share)
    keys = profile_keys(compress_values(df, key, value)).select("key", "n_rows", "n_values", "mode_weight")
    total = df.select(key.alias("key")).where(F.col("key").isNotNull()).agg(F.count(F.lit(1))).scalar()
    return keys.where(F.col("n_rows") * F.lit(den) >= total * F.lit(num))


def _fraction(share: float) -> tuple[int, int]:
    from fractions import Fraction

    f = Fraction(str(share))
    return f.numerator, f.denominator


def weighted_percentiles(pairs: DataFrame, fractions: Sequence[float], n_ranges: int | None = None) -> DataFrame:
    """Exact percentiles per key, ``key, fraction, percentile``, from weighted values.

    The percentile for fraction p is the smallest value whose running weight reaches
    p x (the key's non-null rows), and the smallest value for p = 0. Null values don't count; a
    key without other values has no row. Pairs are ranged over (key, value), so a hot
    key's values spread over many tasks; per-range totals (at most one row per key and
    range) then give each range its offset.
    """
    if any(not 0 <= p <= 1 for p in fractions):
        raise ValueError("fractions must lie between 0 and 1")
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range of a pair must not change if a task is run again, hence the reliable checkpoint.
    ranged = (
        pairs.where(F.col("value").isNotNull())
        .repartitionByRange(n, "key", "value")
        .withColumn("part", F.spark_partition_id())
        .checkpoint()
    )
    totals = ranged.groupBy("key", "part").agg(F.sum("weight").alias("range_weight"))
    by_part = Window.partitionBy("key").orderBy("part")
    offsets = totals.select(
        "key", "part",
        (F.sum("range_weight").over(by_part) - F.col("range_weight")).alias("before"),
        F.sum("range_weight").over(Window.partitionBy("key")).alias("total"),
    )
    inside = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("inside", F.sum("weight").over(inside)).join(offsets, ["key", "part"])
    upto = F.col("before") + F.col("inside")
    asked = F.array(*[F.lit(float(p)) for p in fractions])
    rank = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("total")))
    return (
        running.select("key", "value", "total", (upto - F.col("weight")).alias("low"), upto.alias("high"), F.explode(asked).alias("fraction"))
        .where((F.col("low") < rank) & (rank <= F.col("high")))
        .select("key", "fraction", F.col("value").alias("percentile"))
    )

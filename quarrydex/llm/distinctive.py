"""How distinctive a term is of its record (smoothed language-model divergence).

A record's language model is its term distribution, Dirichlet-smoothed with the
collection's: p(t|d) = (tf + mu p(t)) / (|d| + mu). A term's score is its contribution to
the relative entropy between the two, p(t|d) ln(p(t|d) / p(t)): near zero or negative for
terms as frequent as everywhere, large for rare terms that fill the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.session import shared_dir

#: Pseudo-counts of the collection's distribution in each record.
MU = 100.0


def record_terms(df: DataFrame, record: str, term: str, place: str) -> DataFrame:
    """``record, term, tf``: distinct places of the term in the record; rows without record or term are left out."""
    rows = df.where(F.col(record).isNotNull() & F.col(term).isNotNull())
    rows = rows.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(place).alias("place"))
    # One exchange serves both groupings; a hot term or record spreads over its pairs.
    return rows.repartition("record", "term").distinct().groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf"))


#: Rows and bytes of keys of a table that is sent to every task for a join; a larger one is joined by a shuffle.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 32_000_000


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what reads it more than once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join_by(pairs: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Joins statistics of a key to all pairs: sent to every task if they are measured to be small, else by a shuffle whose hot keys adaptive execution splits."""
    n = stats.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")).first()
    return pairs.join(F.broadcast(stats) if n.rows <= SMALL_ROWS and n.bytes <= SMALL_BYTES else stats, key)


def term_statistics(pairs: DataFrame) -> DataFrame:
    """``term, records, cf``: records that hold the term, and its occurrences in the collection; combined before they are shuffled."""
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("records"), F.sum("tf").alias("cf"))


def score_terms(df: DataFrame, record: str, term: str, place: str, mu: float = MU, min_records: int = 2) -> DataFrame:
    """``record, term, tf, records, score`` of every pair whose term is in at least ``min_records`` records.

    Repeated rows count once. Record lengths and collection probabilities are taken over
    all terms, those below the cutoff too. No rows for an empty table.
    """
    if mu <= 0:
        raise ValueError("mu must be positive")
    pairs = _kept(record_terms(df, record, term, place), "record-terms")
    lengths = _kept(pairs.groupBy("record").agg(F.sum("tf").alias("length")), "record-lengths")
    total = lengths.agg(F.sum("length").cast("double")).scalar()
    terms = _kept(term_statistics(pairs).where(F.col("records") >= min_records), "term-statistics")
    p = F.col("cf") / total
    pd = (F.col("tf") + F.lit(mu) * p) / (F.col("length") + F.lit(mu))
    scored = _join_by(_join_by(pairs, terms, "term"), lengths, "record")
    return scored.select("record", "term", "tf", "records", (pd * F.log(pd / p)).alias("score"))


def standing_out(df: DataFrame, record: str, term: str, place: str) -> DataFrame:
    """``record, term``: pairs with 2 tf >= 3 records, by the same statistics.

    Every term is in some record, so pairs of a single occurrence and terms of too many records never qualify
    and don't reach the join.
    """
    pairs = _kept(record_terms(df, record, term, place), "record-terms")
    stats = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("records"), F.max("tf").alias("most")).where(F.col("most") * 2 >= F.col("records") * 3)
    terms = _kept(stats.select("term", "records"), "term-statistics")
    return _join_by(pairs.where("tf >= 2"), terms, "term").where(F.col("tf") * 2 >= F.col("records") * 3).select("record", "term")


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best terms of each record with ``place`` 1..k; equal scores in order of the term."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("record").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

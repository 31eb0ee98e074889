"""Index tables from a corpus: postings, positions, vocabulary, k-grams, dates.

Records are ``doc_id, text`` and where needed ``valid_start, valid_end, added_at``. Ids
outside 0..2^32-1 and null ids are never indexed; null and empty texts have no terms. All
builders accept repeated rows and ignore further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydex.functions.text import GRAM, analyze, term_grams

MAX_ID = 2**32 - 1


def indexable(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("doc_id").between(0, MAX_ID))


def analyzed(corpus: DataFrame, *also: str | Column) -> DataFrame:
    """``doc_id, terms`` (array) and further columns; rows without terms keep an empty or null array."""
    return indexable(corpus).select("doc_id", analyze(F.col("text")).alias("terms"), *also)


def build_postings(corpus: DataFrame) -> DataFrame:
    """``term, doc_id``, distinct. A record added again keeps its old terms (a grow-only union)."""
    # Terms are made distinct within each record before the shuffle.
    return analyzed(corpus).select(F.explode(F.array_distinct("terms")).alias("term"), "doc_id").distinct()


def build_positions(corpus: DataFrame, version: Column | None = None) -> DataFrame:
    """``doc_id, pos, term``. Of a record added again, the last version (by ``version``, e.g. ``added_at``) wins per term; terms only in earlier ones keep their positions."""
    v = version if version is not None else F.lit(0)
    rows = indexable(corpus).select("doc_id", v.alias("version"), F.posexplode(analyze(F.col("text"))).alias("pos", "term"))
    last = Window.partitionBy("doc_id", "term")
    newest = F.max("version").over(last)
    kept = rows.withColumn("newest", newest).where(F.col("version").eqNullSafe(F.col("newest")))
    return kept.select("doc_id", "term", "pos").distinct().select("doc_id", "pos", "term")


def pack_positions(positions: DataFrame) -> DataFrame:
    """``term, doc_id, positions``: ascending distinct positions of each pair."""
    return positions.groupBy("term", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def build_vocabulary(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("term").isNotNull()).select("term").distinct()


def build_kgrams(vocabulary: DataFrame, k: int = GRAM) -> DataFrame:
    """``gram, term``, distinct for distinct terms; no shuffle."""
    return vocabulary.select(F.explode(term_grams(F.col("term"), k)).alias("gram"), "term")


def build_doc_dates(corpus: DataFrame, version: Column | None = None) -> DataFrame:
    """``doc_id, valid_start, valid_end``: each record's dates as last added (of equal versions the later dates).

    Every indexable record is in, also one without terms.
    """
    v = version if version is not None else F.lit(0)
    best = F.max(F.struct(v.alias("v"), F.col("valid_start").cast("date").alias("s"), F.col("valid_end").cast("date").alias("e")))
    return indexable(corpus).groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.s").alias("valid_start"), F.col("b.e").alias("valid_end"))

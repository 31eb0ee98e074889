"""Searches over index tables. Each returns distinct ``doc_id`` in no particular order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydex.functions.text import analyze_text, normalize_pattern, pattern_grams, prefix_grams
from quarrydex.plans.compile import by_flags, range_column
from quarrydex.plans.language import Range, ordered, parse


def in_order(result: DataFrame) -> DataFrame:
    """A result by ascending id, for output."""
    return result.orderBy("doc_id")


def search(query: str, postings: DataFrame) -> DataFrame:
    """Boolean search."""
    return by_flags(parse(query), postings)


def search_dated(query: str, postings: DataFrame, doc_dates: DataFrame) -> DataFrame:
    """Boolean search with day ranges."""
    return by_flags(parse(query, dated=True), postings, doc_dates)


def difference(kept: DataFrame, removed: DataFrame) -> DataFrame:
    """Records of one result that aren't in another."""
    return kept.join(removed.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()


def _in_range(kind: str, doc_dates: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    return doc_dates.where(range_column(Range(kind, *ordered(a, b)))).select("doc_id").distinct()


def appeared_in_range(doc_dates: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    """Records that start within the closed range; reversed bounds are swapped."""
    return _in_range("appeared", doc_dates, a, b)


def valid_in_range(doc_dates: DataFrame, a: dt.date, b: dt.date) -> DataFrame:
    """Records valid on some day of the closed range; a null end is open."""
    return _in_range("valid", doc_dates, a, b)


def search_prefix(prefix: str, postings: DataFrame) -> DataFrame:
    """Records with a term (a stem) that starts with the prefix, which isn't stemmed."""
    p = normalize_pattern(prefix)
    if not p:
        raise ValueError("empty prefix")
    return postings.where(F.col("term").startswith(p)).select("doc_id").distinct()


def matches(pattern: str):
    """A normalized wildcard pattern as a condition on ``term``; only ``*`` is special."""
    return F.col("term").like(pattern.replace("*", "%")) if "*" in pattern else F.col("term") == pattern


def _pattern(pattern: str) -> str:
    p = normalize_pattern(pattern)
    if not p:
        raise ValueError("empty wildcard")
    return p


def search_wildcard(pattern: str, postings: DataFrame) -> DataFrame:
    """Records with a term matching the pattern; without ``*``, exactly that term, not stemmed."""
    return postings.where(matches(_pattern(pattern))).select("doc_id").distinct()


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def kgram_candidates(grams: list[str], kgrams: DataFrame) -> DataFrame:
    """``term``s that have all of ``grams``; without grams, the whole vocabulary."""
    if not grams:
        return kgrams.select("term").distinct()
    bit = F.coalesce(*[F.when(F.col("gram") == g, F.lit(i)) for i, g in enumerate(grams)])
    hits = kgrams.where(F.col("gram").isin(grams))
    if len(grams) <= 62:  # one bit a gram: combines partially, however often a row is repeated
        return hits.groupBy("term").agg(F.bit_or(_bit(bit)).alias("m")).where(F.col("m") == 2 ** len(grams) - 1).select("term")
    return hits.groupBy("term").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("term")


def search_wildcard_by_kgrams(pattern: str, kgrams: DataFrame, postings: DataFrame) -> DataFrame:
    """:func:`search_wildcard` through the k-gram index: candidates, check, postings."""
    p = _pattern(pattern)
    terms = kgram_candidates(pattern_grams(p), kgrams).where(matches(p))
    return postings.join(terms, "term", "left_semi").select("doc_id").distinct()


def search_prefix_by_kgrams(prefix: str, kgrams: DataFrame, postings: DataFrame) -> DataFrame:
    """:func:`search_prefix` through the k-gram index."""
    p = normalize_pattern(prefix)
    if not p:
        raise ValueError("empty prefix")
    terms = kgram_candidates(prefix_grams(p), kgrams).where(F.col("term").startswith(p))
    return postings.join(terms, "term", "left_semi").select("doc_id").distinct()


def search_phrase(phrase: str, positions: DataFrame) -> DataFrame:
    """Records in which the phrase's terms follow each other; stop words drop out on both sides.

    One scan and one aggregation whatever the length: a term at position p that is the
    phrase's i-th votes for a phrase at p - i, and a phrase is where all slots vote.
    """
    terms = analyze_text(phrase)
    if not terms:
        raise ValueError("empty phrase")
    return phrase_terms(terms, positions)


def phrase_terms(terms: list[str], positions: DataFrame) -> DataFrame:
    """:func:`search_phrase` for analyzed terms."""
    if len(terms) == 1:
        return positions.where(F.col("term") == terms[0]).select("doc_id").distinct()
    slots = {}
    for i, t in enumerate(terms):
        slots.setdefault(t, []).append(i)
    of = F.coalesce(*[F.when(F.col("term") == t, F.array(*map(F.lit, s))) for t, s in slots.items()])
    votes = positions.where(F.col("term").isin(list(slots))).select("doc_id", "pos", F.explode(of).alias("slot"))
    at = votes.groupBy("doc_id", (F.col("pos") - F.col("slot")).alias("start"))
    if len(terms) <= 62:
        whole = at.agg(F.bit_or(_bit(F.col("slot"))).alias("m")).where(F.col("m") == 2 ** len(terms) - 1)
    else:
        whole = at.agg(F.count_distinct("slot").alias("n")).where(F.col("n") == len(terms))
    return whole.select("doc_id").distinct()


def phrase_scan(phrase: str, analyzed: DataFrame, terms: str = "terms") -> DataFrame:
    """:func:`search_phrase` on records with an array of terms, without a shuffle before the last distinct."""
    p = analyze_text(phrase)
    if not p:
        raise ValueError("empty phrase")
    n, t = len(p), F.col(terms)
    wanted = F.array(*map(F.lit, p))
    starts = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
    hit = (F.size(t) >= n) & F.exists(starts, lambda i: F.slice(t, i, F.lit(n)) == wanted)
    return analyzed.where(hit).select("doc_id").distinct()

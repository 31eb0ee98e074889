"""Syntax trees to plans.

``flags``  one pass over the postings: a flag per term and record, then the tree as a
           filter. One shuffle whatever the depth; the default.
``sets``   intersections and unions of posting lists, as written.
``scan``   array tests on analyzed records, no shuffle; for one-off queries without an index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydex.functions.text import normalize_word
from quarrydex.plans.language import And, Node, Or, Range, Term, leaves


def range_column(r: Range) -> Column:
    """A range as a condition on ``valid_start`` and ``valid_end`` (null end: open); false, not null, where start is null."""
    start, end = F.col("valid_start"), F.col("valid_end")
    low, high = F.lit(r.low), F.lit(r.high)
    hit = start.between(low, high) if r.kind == "appeared" else (start <= high) & (end.isNull() | (end >= low))
    return F.coalesce(hit, F.lit(False))


def condition(tree: Node, leaf: Callable[[Term | Range], Column]) -> Column:
    """The tree as one boolean column over its leaves' columns."""
    if isinstance(tree, And):
        return condition(tree.left, leaf) & condition(tree.right, leaf)
    if isinstance(tree, Or):
        return condition(tree.left, leaf) | condition(tree.right, leaf)
    return leaf(tree)


def _terms(tree: Node) -> list[str]:
    """Distinct analyzed words; a stop word analyzes to '' and matches nothing."""
    return list(dict.fromkeys(t for x in leaves(tree) if isinstance(x, Term) if (t := normalize_word(x.word))))


def by_flags(tree: Node, postings: DataFrame, doc_dates: DataFrame | None = None) -> DataFrame:
    """``doc_id`` of the records that satisfy the tree.

    With ranges the universe is ``doc_dates``, as records without any posting may match;
    without, every match has a posting.
    """
    terms = _terms(tree)
    at = {t: i for i, t in enumerate(terms)}
    dated = any(isinstance(x, Range) for x in leaves(tree))
    if dated and doc_dates is None:
        raise ValueError("ranges need dated documents")

    def leaf(x: Term | Range) -> Column:
        if isinstance(x, Range):
            return range_column(x)
        i = at.get(normalize_word(x.word))
        return F.lit(False) if i is None else F.coalesce(F.col(f"f_{i}"), F.lit(False))

    hits = postings.where(F.col("term").isin(terms)) if terms else postings.where(F.lit(False))
    flags = hits.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(f"f_{i}") for t, i in at.items()] or [F.count(F.lit(1)).alias("n")])
    base = doc_dates.join(flags, "doc_id", "left") if dated else flags
    return base.where(condition(tree, leaf)).select("doc_id")


def by_sets(tree: Node, postings: DataFrame, doc_dates: DataFrame | None = None) -> DataFrame:
    """The same by set operations on posting lists."""
    if isinstance(tree, And):
        return by_sets(tree.left, postings, doc_dates).intersect(by_sets(tree.right, postings, doc_dates))
    if isinstance(tree, Or):
        return by_sets(tree.left, postings, doc_dates).union(by_sets(tree.right, postings, doc_dates)).distinct()
    if isinstance(tree, Range):
        if doc_dates is None:
            raise ValueError("ranges need dated documents")
        return doc_dates.where(range_column(tree)).select("doc_id").distinct()
    return postings.where(F.col("term") == normalize_word(tree.word)).where(F.col("term") != "").select("doc_id").distinct()


def by_scan(tree: Node, analyzed: DataFrame, terms: str = "terms") -> DataFrame:
    """The same on records with an array of terms (and dates, where the tree has ranges)."""

    def leaf(x: Term | Range) -> Column:
        if isinstance(x, Range):
            return range_column(x)
        t = normalize_word(x.word)
        return F.coalesce(F.array_contains(terms, t), F.lit(False)) if t else F.lit(False)

    return analyzed.where(condition(tree, leaf)).select("doc_id").distinct()

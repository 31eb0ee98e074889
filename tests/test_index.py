"""Golden results and properties of the index objects."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrydex.operators import bitmaps, index, search
from quarrydex.operators.engine import BooleanIndex, DatedIndex, GramIndex, PositionalIndex
from quarrydex.plans.compile import by_flags, by_scan, by_sets
from quarrydex.plans.language import And, Or, Range, Term

F1 = [(1, "running fast with maps"), (2, "run bloom filter"), (3, "roaring bitmap index bloom"), (4, "maps bitmap")]
D = dt.date


def ids(df):
    got = [r.doc_id for r in df.collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def filled(index_, docs):
    for d in docs:
        index_.add_document(*d)
    return index_


@pytest.mark.parametrize("kind", [BooleanIndex, GramIndex])
def test_boolean(spark, tmp_path, kind):
    x = filled(kind(spark, str(tmp_path)), F1)
    assert ids(x.search("run AND map")) == [1]
    assert ids(x.search("run OR bitmap")) == [1, 2, 3, 4]
    assert ids(x.search("(run OR bloom) AND bitmap")) == [3]
    assert ids(x.search("run AND the")) == [] and ids(x.search("run OR the")) == [1, 2]
    x.compact()
    assert ids(x.search("(run OR bloom) AND bitmap")) == [3]


@pytest.mark.parametrize("kind", [BooleanIndex, GramIndex])
def test_after_compaction(spark, tmp_path, kind):
    x = filled(kind(spark, str(tmp_path), max_size=2), [(1, "running map"), (2, "run bloom"), (3, "map bloom")])
    assert ids(x.search("run AND bloom")) == [2]
    x.compact()
    assert ids(x.search("run AND bloom")) == [2]
    again = kind(spark, str(tmp_path))  # a store outlives its object
    assert ids(again.search("run AND bloom")) == [2]
    again.add_document(2, "slot")  # old terms stay
    assert ids(again.search("run AND slot")) == [2]


def test_prefix_and_wildcard(spark, tmp_path):
    x = filled(GramIndex(spark, str(tmp_path / "a")), F1)
    assert ids(x.search_prefix("ru")) == [1, 2] and ids(x.search_prefix("running")) == [] and ids(x.search_prefix("ru*")) == []
    y = filled(GramIndex(spark, str(tmp_path / "b")), [(1, "running fast"), (2, "runner slow"), (3, "bloom bitmap")])
    assert ids(y.search_wildcard("run*")) == [1, 2] and ids(y.search_wildcard("*oom")) == [3] and ids(y.search_wildcard("run-*")) == [1, 2]
    assert ids(y.search_wildcard("running")) == [] and ids(y.search_wildcard("*")) == [1, 2, 3] == ids(y.search_wildcard("**"))
    for f, text in ((y.search_prefix, "!!"), (y.search_wildcard, "")):
        with pytest.raises(ValueError, match="empty"):
            f(text)


def test_wildcards_go_through_stored_kgrams(spark, tmp_path):
    x = filled(GramIndex(spark, str(tmp_path), max_size=2), F1)
    x.compact()
    plan = x.search_wildcard("*oom")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan and "LeftSemi" in plan  # grams select terms, terms select postings
    direct = x.search_wildcard("blo*")._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in direct and "StringStartsWith(term,blo)" in direct
    assert ids(x.search_wildcard("*oom")) == [2, 3] == ids(x.search_wildcard("blo*"))
    assert ids(search.difference(x.search("run OR bloom"), x.search("map"))) == [2, 3]


def test_kgrams_equal_like(spark):
    words = ["run", "runner", "red", "retired", "bloom", "oo", "a", "größe", "aaaa", "barn", "urn"]
    postings = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, doc_id bigint")
    grams = index.build_kgrams(index.build_vocabulary(postings))
    for p in ("run*", "*oom", "red*", "r*n", "*u*n*", "*", "a*", "*aa*", "größ*", "*zzz*"):
        assert ids(search.search_wildcard_by_kgrams(p, grams, postings)) == ids(search.search_wildcard(p, postings)), p
    for p in ("r", "ru", "run", "zz", "aaa"):
        assert ids(search.search_prefix_by_kgrams(p, grams, postings)) == ids(search.search_prefix(p, postings)), p


def test_dates(spark, tmp_path):
    a = filled(DatedIndex(spark, str(tmp_path / "a")), [(1, F1[0][1], D(2020, 1, 10)), (2, F1[1][1], D(2021, 6, 15)), (3, F1[2][1], D(2020, 3, 1))])
    for q, want in (("[2020-01-01,2020-12-31]", [1, 3]), ("DATE[2020-01-01,2020-12-31]", [1, 3]), ("run AND [2020-01-01,2020-12-31]", [1]), ("bitmap OR [2021-01-01,2021-12-31]", [2, 3])):
        assert ids(a.search(q)) == want
    b = filled(DatedIndex(spark, str(tmp_path / "b")), [(1, "a", D(2022, 1, 1)), (2, "b", D(2023, 1, 1))])
    assert ids(b.search_date_in_range(D(2022, 12, 31), D(2022, 1, 1))) == [1]  # also a text of stop words only, bounds reversed
    c = filled(DatedIndex(spark, str(tmp_path / "c")), [(1, "alpha", D(2020, 1, 1), D(2020, 6, 30)), (2, "beta", D(2020, 5, 1)), (3, "gamma", D(2020, 3, 1), D(2020, 3, 31))])
    assert ids(c.search_valid_in_range(D(2020, 7, 1), D(2020, 7, 31))) == [2]
    assert ids(c.search_valid_in_range(D(2020, 3, 1), D(2020, 3, 31))) == [1, 3]
    c.add_document(2, "beta", D(1950, 1, 1), D(1951, 1, 1))  # the last dates count
    c.compact()
    assert ids(c.search_valid_in_range(D(2020, 7, 1), D(2020, 7, 31))) == [] and ids(c.search_valid_in_range(D(1950, 7, 1), D(1950, 7, 31))) == [2]
    d = filled(DatedIndex(spark, str(tmp_path / "d")), [(1, "a", D(2019, 1, 1), D(2020, 1, 1)), (2, "b", D(2020, 6, 1)), (3, "c", D(2021, 1, 1))])
    assert ids(d.search_appeared_in_range(D(2020, 1, 1), D(2020, 12, 31))) == [2]
    e = filled(DatedIndex(spark, str(tmp_path / "e"), max_size=2), [(1, "cat dog", D(2020, 1, 1), D(2020, 12, 31)), (2, "cat dog", D(2021, 1, 1), D(2021, 6, 30)), (3, "dog fish", D(2020, 6, 1))])
    assert ids(e.search("cat AND VALID[2020-06-01,2020-06-30]")) == [1] and ids(e.search("dog AND APPEARED[2021-01-01,2021-12-31]")) == [2]
    f = filled(DatedIndex(spark, str(tmp_path / "f")), [(i, t, D(2000, 1, 1)) for i, t in F1])
    assert ids(f.search("run AND map")) == [1]


def test_phrases(spark, tmp_path):
    a = filled(PositionalIndex(spark, str(tmp_path / "a")), [(1, "running fast with maps"), (2, "fast running with maps"), (3, "running quickly with maps"), (4, "bloom filter bitmap index"), (5, "bitmap index with bloom filter")])
    wanted = {"running fast": [1], "fast running": [2], "running maps": [2], "bloom filter": [4, 5], "bitmap index": [4, 5], "index bloom": [5], "maps": [1, 2, 3], "unknown phrase": []}
    for p, want in wanted.items():
        assert ids(a.search_phrase(p)) == want, p
    b = filled(PositionalIndex(spark, str(tmp_path / "b")), [(1, "run run bloom"), (2, "run bloom bloom"), (3, "run bloom run bloom")])
    for p, want in {"run run": [1], "run bloom": [1, 2, 3], "bloom run": [3]}.items():
        assert ids(b.search_phrase(p)) == want, p
    c = filled(PositionalIndex(spark, str(tmp_path / "c"), max_size=2), [(1, "running fast maps"), (2, "maps fast running"), (3, "bitmap bloom index")])
    c.compact()
    assert ids(c.search_phrase("running fast")) == [1] and ids(c.search_phrase("bitmap bloom")) == [3]
    c.add_document(1, "fast running")  # replaces positions per term; "map" keeps its own
    assert ids(c.search_phrase("running fast")) == [] and ids(c.search_phrase("fast running")) == [1, 2] and ids(c.search_phrase("maps")) == [1, 2]
    for p in ("", "   ", "the"):
        with pytest.raises(ValueError, match="empty phrase"):
            c.search_phrase(p)


def test_phrase_plans_agree(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["red", "blue", "green"]) for _ in range(r.randrange(8)))) for i in range(60)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    positions, rows = index.build_positions(corpus), index.analyzed(corpus)
    for p in ("red", "red blue", "blue blue", "green red green", "red " * 5):
        assert ids(search.search_phrase(p, positions)) == ids(search.phrase_scan(p, rows)) == sorted(i for i, t in docs if f" {p.strip()} " in f" {t} "), p
    long = " ".join(["red", "blue"] * 40)
    more = spark.createDataFrame([(1, long), (2, long[4:])], "doc_id bigint, text string")
    assert ids(search.search_phrase(long, index.build_positions(more))) == [1]


def test_boolean_plans_agree(spark):
    r = random.Random(7)
    words = ["red", "blue", "green", "grey", "the"]
    docs = [(i, " ".join(r.sample(words, r.randrange(4))), D(2020, 1, 1) + dt.timedelta(r.randrange(60)), r.choice([None, D(2020, 2, 1), D(2019, 1, 1)])) for i in range(80)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string, valid_start date, valid_end date")
    postings, dates = index.build_postings(corpus), index.build_doc_dates(corpus)
    rows = index.analyzed(corpus, "valid_start", "valid_end")

    def tree(n):
        if n == 0:
            return r.choice([Term(r.choice([*words, "unknown"])), Range(r.choice(["valid", "appeared"]), D(2020, 1, 10), D(2020, 1, 20))])
        return r.choice([And, Or])(tree(n - 1), tree(n - 1))

    for _ in range(8):
        t = tree(r.randrange(1, 4))
        assert ids(by_flags(t, postings, dates)) == ids(by_sets(t, postings, dates)) == ids(by_scan(t, rows)), t


def test_dirty_corpus(spark):
    rows = [(None, "run"), (-1, "run"), (2**32, "run"), (2**32 - 1, "run"), (0, None), (0, ""), (5, "run run"), (5, "run run")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("term", F.lit("clash")).withColumn("pos", F.lit(9))
    assert sorted((r.term, r.doc_id) for r in index.build_postings(corpus).collect()) == [("run", 5), ("run", 2**32 - 1)]
    assert sorted(tuple(r) for r in index.build_positions(corpus).collect()) == [(5, 0, "run"), (5, 1, "run"), (2**32 - 1, 0, "run")]
    empty = corpus.where("false")
    assert index.build_postings(empty).count() == index.build_positions(empty).count() == 0


def test_bitmaps_and_slices(spark):
    rows = [(t, i) for t, step in (("a", 2), ("b", 3), ("c", 40000)) for i in range(0, 100_000, step)] + [("a", 0), (None, 1), ("a", None)]
    packed = bitmaps.pack_postings(spark.createDataFrame(rows, "term string, doc_id bigint"))
    n = lambda df: df.first().n
    assert n(bitmaps.count_all(packed, ["a", "b"])) == len(range(0, 100_000, 6)) and n(bitmaps.count_all(packed, ["a", "x"])) == 0
    assert n(bitmaps.count_any(packed, ["a", "b"])) == len({*range(0, 100_000, 2), *range(0, 100_000, 3)})
    days = spark.range(-800_00, 80_000, 371).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d")).union(spark.sql("SELECT CAST(NULL AS date)"))
    for a, b in ((D(1969, 12, 30), D(1970, 1, 3)), (D(1800, 5, 5), D(2100, 7, 7)), (D(2000, 1, 1), D(2000, 1, 1)), (D(2020, 5, 1), D(1999, 1, 1))):
        lo, hi = min(a, b), max(a, b)
        assert days.where(bitmaps.sliced_range(F.col("d"), a, b)).count() == days.where(F.col("d").between(lo, hi)).count()

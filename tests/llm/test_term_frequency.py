import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrydex.llm.term_frequency import BurstTrie, count_terms, mark_items, pack, route, routing_prefixes, unpack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=300), st.integers(1, 8))
def test_trie_counts_and_sorts(terms, capacity):
    trie = BurstTrie(capacity)
    for t in terms:
        trie.add(t, 2, 1)
    c = Counter(terms)
    got = [(t, tuple(x)) for t, x in trie.items()]
    assert got == [(t, (2 * n, n)) for t, n in sorted(c.items())] and trie.size == len(c)
    items = list(trie.items())
    assert [(t, o, r) for t, o, r in unpack(pack(items))] == [(t, *x) for t, x in items]


def test_routes_agree():
    longer = {b"a": 2, b"ab": 5}
    assert [route(t, longer) for t in (b"abcdef", b"abc", b"ab", b"a", b"b", b"", b"ax", b"axy")] == [b"abcde", b"abc", b"ab", b"a", b"b", b"", b"ax", b"ax"]


def brute(rows):
    places, records = defaultdict(set), defaultdict(set)
    for d, p, t in rows:
        if t is not None and d is not None:
            places[t].add((d, p))
            records[t].add(d)
    return {t: (len(places[t]), len(records[t])) for t in places}


def test_against_brute_force(spark):
    r = random.Random(6)
    terms = ["hot", "Hot", "hot ", "", "é", "é", "z" * 5000, None, *(f"{r.choice('ab')}{r.randrange(300)}" for _ in range(200))]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(20)]), "hot" if r.random() < 0.4 else r.choice(terms)) for _ in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, term string").withColumn("item", F.lit("clash")).withColumn("n", F.lit(0)).repartition(7)
    got = {x.item: (x.occurrences, x.records) for x in count_terms(df, "term", "doc_id", "pos").collect()}
    assert got == brute(rows)
    alone = {x.item: (x.occurrences, x.records) for x in count_terms(df, "term", "doc_id").collect()}
    assert alone == {t: (n, n) for t, (_, n) in brute(rows).items()}
    total = len({d for d, _, t in rows if d is not None and t is not None})
    marks = {x.item: x.mark for x in mark_items(count_terms(df, "term", "doc_id", "pos"), F.lit(total), 2, 0.2).collect()}
    assert marks == {t: "rare" if n <= 2 else "common" if n * 5 > total else None for t, (_, n) in brute(rows).items()}


def test_long_routes_merge(spark):
    """Terms with a long common beginning spread, and the counts are those of any other routing."""
    rows = [(i % 9, i, f"https://www.example.org/a/long/path/to/{'x' * (i % 2) * 300}page-{i % 500:03d}") for i in range(3000)] + [(1, -1, "h"), (1, -2, "https:/")]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, term string").repartition(5)
    longer = routing_prefixes(df.select("term"), weight=20)
    shares = Counter(route(t.encode(), longer) for t in {t for _, _, t in rows})
    assert max(shares.values()) <= 20 and len(shares) > 25 and max(len(p) for p in shares) > 300
    for weight in (20, 1, None):
        got = {x.item: (x.occurrences, x.records) for x in count_terms(df, "term", "doc_id", "pos", weight).collect()}
        assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, pos int, term string")
    assert count_terms(df, "term", "doc_id", "pos").count() == 0
    assert count_terms(spark.createDataFrame([(1, 1, None)], df.schema), "term", "doc_id").count() == 0

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrydex.llm.distinctive import score_terms, standing_out, top_terms


def brute(rows, mu, min_records):
    seen = {r for r in rows if r[0] is not None and r[2] is not None}
    tf, length, df, cf = Counter((d, t) for d, _, t in seen), Counter(d for d, _, _ in seen), defaultdict(set), Counter(t for _, _, t in seen)
    for d, _, t in seen:
        df[t].add(d)
    out = {}
    for (d, t), n in tf.items():
        p = cf[t] / len(seen)
        pd = (n + mu * p) / (length[d] + mu)
        if len(df[t]) >= min_records:
            out[d, t] = (n, len(df[t]), pd * math.log(pd / p))
    return out


def rows_(seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(15)]), r.choice([None, *range(30)]), r.choice(["common"] * 9 + [None, "", "Rare", "rare", "w" * 4000, *(f"t{i}" for i in range(25))])) for _ in range(900)]
    return rows + rows[:100] + [(3, 100 + i, "solo") for i in range(4)] + [(4, 100 + i, "duo") for i in range(3)] + [(5, 100, "duo")]


def test_against_brute_force(spark):
    rows = rows_(2)
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, term string").withColumn("record", F.lit("clash")).withColumn("tf", F.lit(3))
    for mu, cut in ((100.0, 2), (5.0, 1), (50.0, 4)):
        got = {(x.record, x.term): (x.tf, x.records, x.score) for x in score_terms(df, "doc_id", "term", "pos", mu, cut).collect()}
        want = brute(rows, mu, cut)
        assert got.keys() == want.keys()
        for k, (n, records, score) in want.items():
            assert got[k][:2] == (n, records) and math.isclose(got[k][2], score, rel_tol=1e-9, abs_tol=1e-12)
    found = {(x.record, x.term) for x in standing_out(df, "doc_id", "term", "pos").collect()}
    assert found == {k for k, (n, records, _) in brute(rows, 1, 1).items() if 2 * n >= 3 * records}
    assert found


def test_contributions_sum_to_the_divergence(spark):
    """With every term of a record scored, scores plus the rest of the vocabulary make up the relative entropy, which is never negative."""
    rows = [(d, i, t) for d, text in enumerate(["a a b", "b c", "c c c d"]) for i, t in enumerate(text.split())]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, term string")
    scores = {(x.record, x.term): x.score for x in score_terms(df, "doc_id", "term", "pos", 3.0, 1).collect()}
    cf = Counter(t for _, _, t in rows)
    for d in range(3):
        n = sum(r[0] == d for r in rows)
        rest = sum(p * 3 / (n + 3) * math.log(3 / (n + 3)) for t, c in cf.items() if (d, t) not in scores for p in [c / len(rows)])
        assert sum(s for (x, _), s in scores.items() if x == d) + rest > 0


def test_top_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9), (2, "z", -1.0)], "record bigint, term string, score double")
    assert sorted((x.record, x.rank, x.term) for x in top_terms(df, 2).collect()) == [(1, 1, "c"), (1, 2, "a"), (2, 1, "z")]
    empty = spark.createDataFrame([], "doc_id bigint, pos int, term string")
    assert score_terms(empty, "doc_id", "term", "pos").count() == standing_out(empty, "doc_id", "term", "pos").count() == 0
    with pytest.raises(ValueError):
        score_terms(empty, "doc_id", "term", "pos", mu=0)

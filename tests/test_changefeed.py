import random

import pytest
from pyspark.sql import functions as F

from quarrydex.operators.changefeed import live_rows, replay_changes

SCHEMA = "key string, seq bigint, op string, a string, b bigint"


def replayed(changes):
    """The brute-force state machine."""
    state = {}
    for key, seq, op, a, b in sorted((c for c in changes if c[0] is not None and c[1] is not None), key=lambda c: (c[0], c[1])):
        s = state.setdefault(key, {"seq": None, "live": False, "a": None, "b": None})
        if s["seq"] == seq:
            continue
        s["seq"] = seq
        if op == "delete":
            s |= {"live": False, "a": None, "b": None}
        else:
            s["live"] = True
            s["a"] = a if a is not None else s["a"]
            s["b"] = b if b is not None else s["b"]
    return {k: (s["seq"], s["a"], s["b"]) for k, s in state.items() if s["live"]}


def run(spark, changes, applied=None, partitions=5):
    df = spark.createDataFrame(changes, SCHEMA).repartition(partitions).withColumn("__seq", F.lit("clash")).withColumn("deleted_seq", F.lit(1))
    return replay_changes(df, ["key"], "seq", ["a", "b"], F.col("op") == "delete", applied=applied)


def rows(states):
    return {r.key: (r.seq, r.a, r.b) for r in live_rows(states).collect()}


def feed(seed, n=500):
    r = random.Random(seed)
    base = [(r.choice(["hot"] * 10 + [f"k{i}" for i in range(15)] + ["K1", "k1 ", "", None]), None if r.random() < 0.02 else i, r.choice(["insert", "update", "update", "delete"]),
             r.choice([None, "", f"a{i}"]), r.choice([None, i])) for i in range(n)]
    out = base + r.sample(base, n // 5)
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, seed):
    changes = feed(seed)
    assert rows(run(spark, changes)) == replayed(changes)


def test_resumes_and_skips_applied(spark):
    changes = feed(9)
    first, second = changes[:300], changes[200:]  # overlapping deliveries, the second partly older
    states = run(spark, first)
    assert rows(run(spark, second, applied=states)) == replayed(changes)
    assert rows(run(spark, changes, applied=run(spark, changes))) == replayed(changes)


def test_order_and_partitions_do_not_matter(spark):
    changes = feed(5)
    assert rows(run(spark, changes, partitions=1)) == rows(run(spark, changes[::-1], partitions=9))


def test_ties_nulls_empty(spark):
    ties = [("x", 1, "update", "a", 1), ("x", 1, "update", "b", None), ("y", 1, "update", "a", 1), ("y", 1, "delete", None, None), ("z", -5, "update", "", None), ("w", 3, None, "q", None)]
    got = rows(run(spark, ties))
    assert got == {"x": (1, "b", 1), "z": (-5, "", None), "w": (3, "q", None)}  # of equal sequences: deletes, then larger values
    assert run(spark, []).count() == 0
    assert rows(run(spark, [(None, 1, "update", "a", 1), ("a", None, "update", "a", 1)])) == {}
    big = [("long", i, "update", "v" * 200_000, None) for i in range(20)]
    assert rows(run(spark, big)) == {"long": (19, "v" * 200_000, None)}
    with pytest.raises(ValueError):
        replay_changes(spark.createDataFrame(ties, SCHEMA), ["key"], "seq", ["key"], F.lit(False))


def test_compound_keys_and_nested_values(spark):
    df = spark.createDataFrame([(1, "a", 1, [1, 2]), (1, "a", 1, [3]), (1, "a", 1, [1, 2]), (1, "b", 2, [5]), (2, "a", 1, None)], "k1 int, k2 string, seq int, v array<int>")
    got = live_rows(replay_changes(df, ["k1", "k2"], "seq", ["v"], F.lit(False))).collect()
    assert sorted((r.k1, r.k2, r.v) for r in got if r.k1 == 1) == [(1, "a", [3]), (1, "b", [5])] and len(got) == 3

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrydex.operators.profile import compress_values, heavy_keys, profile_keys, weighted_percentiles


def table(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"k string, v {kind}").withColumn("key", F.lit("clash")).withColumn("weight", F.lit(7))


def pairs(spark, rows, kind="bigint"):
    return compress_values(table(spark, rows, kind), F.col("k"), F.col("v"))


def heavy(spark, rows, share):
    return {x.key for x in heavy_keys(table(spark, rows), F.col("k"), F.col("v"), share).collect()}


def test_profile_and_percentiles(spark):
    r = random.Random(3)
    rows = [("hot", r.randrange(50)) for _ in range(600)] + [(f"k{r.randrange(20)}", r.choice([None, 1, 2, 3])) for _ in range(300)]
    rows += [(None, 1), ("nulls", None), ("nulls", None), ("", 5), ("tie", 4), ("tie", 2), ("Tie", 9), ("tie ", 1)]
    p = pairs(spark, rows).cache()
    by = {}
    for k, v in rows:
        if k is not None:
            by.setdefault(k, []).append(v)
    got = {x.key: x for x in profile_keys(p).collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        known = [v for v in vs if v is not None]
        c, g = Counter(known), got[k]
        mode = min((v for v in c if c[v] == max(c.values())), default=None)
        assert (g.n_rows, g.n_null, g.n_values, g.mode, g.mode_weight) == (len(vs), len(vs) - len(known), len(c), mode, c.get(mode)), k
        assert (g.min_value, g.max_value) == (min(known, default=None), max(known, default=None))
    fractions = [0, 0.25, 0.5, 0.9, 1]
    perc = {(x.key, x.fraction): x.percentile for x in weighted_percentiles(p, fractions, n_ranges=5).collect()}
    want = {(k, f): sorted(known)[max(1, math.ceil(f * len(known))) - 1] for k, vs in by.items() if (known := [v for v in vs if v is not None]) for f in fractions}
    assert perc == want


def test_heavy(spark):
    rows = [("a", i) for i in range(50)] + [("b", 1)] * 49 + [("c", None)] + [(None, 1)] * 400
    assert heavy(spark, rows, 0.5) == {"a"}
    assert heavy(spark, rows, 0.49) == {"a", "b"}
    assert heavy(spark, rows, 0.01) == {"a", "b", "c"}


def test_empty_and_other_types(spark):
    assert len(heavy(spark, [], 0.02)) == profile_keys(pairs(spark, [])).count() == weighted_percentiles(pairs(spark, []), [0.5]).count() == 0
    text = pairs(spark, [("a", "x" * 100_000), ("a", ""), ("a", "")], "string")
    assert profile_keys(text).first().mode == "" and weighted_percentiles(text, [1.0]).first().percentile == "x" * 100_000
    with pytest.raises(ValueError):
        weighted_percentiles(text, [1.5])

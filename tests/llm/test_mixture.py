import random
from fractions import Fraction as Fr

import pytest
from pyspark.sql import functions as F

from quarrydex.llm import mixture as M


def target(s, share, repeats):
    return M.Target(s, Fr(str(share)), repeats)


def test_flow_is_the_rule_without_overlap():
    r = random.Random(5)
    for _ in range(60):
        names = [f"s{i}" for i in range(r.randrange(1, 6))]
        weights = [r.randrange(1, 20) for _ in names]
        targets = [M.Target(n, Fr(w, sum(weights)), r.randrange(0, 5)) for n, w in zip(names, weights)]
        sizes = {(n,): r.choice([0, 1, 7, 100]) for n in names}
        total = sum(sizes.values())
        plan = M.plan_mixture(sizes, targets, total)
        assert M.unreachable(plan) == sorted(t.source for t in targets if sizes[t.source,] * t.max_repeats < t.share * total)
        for t in targets:
            got = sum((v for (_, s), v in plan.routed.items() if s == t.source), Fr(0))
            assert got == min(t.share * total, sizes[t.source,] * t.max_repeats)


def test_overlap_and_convex_costs():
    targets = [target("a", 0.5, 1), target("b", 0.5, 1)]
    # Only the shared pattern can serve b; a must leave it to b.
    plan = M.plan_mixture({("a",): 100, ("a", "b"): 100}, targets, 200)
    assert not M.unreachable(plan) and plan.routed[("a", "b"), "b"] == 100 and plan.routed[("a",), "a"] == 100
    # Repeating both patterns a little is cheaper than one of them a lot.
    plan = M.plan_mixture({("a",): 100, ("a", "b"): 100}, [target("a", 1, 4)], 400)
    assert plan.routed[("a",), "a"] == plan.routed[("a", "b"), "a"] == 200
    plan = M.plan_mixture({("a",): 1}, [target("a", 1, 1000)], 900)
    assert plan.routed[("a",), "a"] == 900


def cheapest_by_paths(patterns, targets, total):
    """Least cost by single units: each is sent along a path to the pattern with the fewest uses that can take it (small cases)."""
    wanted = {t.source: t for t in targets}
    left = {t.source: int(t.share * total) for t in targets}
    units = {p: n for p, n in patterns.items()}
    flow = {(p, s): 0 for p in patterns for s in p}
    cap = {(p, s): patterns[p] * wanted[s].max_repeats for p, s in flow}

    def path(p):
        queue, came = [("p", p)], {("p", p): None}
        for kind, x in queue:
            nexts = [("s", s) for s in x if flow[x, s] < cap[x, s]] if kind == "p" else [("p", y) for y in patterns if x in y and flow[y, x]]
            if kind == "s" and left[x]:
                out, at = [], (kind, x)
                while at:
                    out.append(at)
                    at = came[at]
                return out[::-1]
            for y in nexts:
                if y not in came:
                    came[y] = (kind, x)
                    queue.append(y)
        return None

    cost = 0
    for k in range(1, 1 + max(t.max_repeats for t in targets)):
        for p in patterns:
            for _ in range(units[p] if k <= max(wanted[s].max_repeats for s in p) else 0):
                if not (way := path(p)):
                    break
                for (ka, x), (_, y) in zip(way, way[1:]):
                    if ka == "p":
                        flow[x, y] += 1
                    else:
                        flow[y, x] -= 1
                left[way[-1][1]] -= 1
                cost += k
    return cost, left


def cost_of(plan, patterns):
    out = 0
    for p, n in patterns.items():
        uses = sum((v for (q, _), v in plan.routed.items() if q == p), Fr(0))
        k = 1
        while uses > 0 and n:
            out += k * min(n, uses)
            uses -= n
            k += 1
    return out


def test_flow_is_cheapest():
    r = random.Random(11)
    for _ in range(150):
        names = [f"s{i}" for i in range(r.randrange(1, 5))]
        targets = [M.Target(n, Fr(1, len(names)), r.randrange(0, 4)) for n in names]
        patterns = {tuple(sorted(r.sample(names, r.randrange(1, len(names) + 1)))): r.randrange(1, 12) for _ in range(r.randrange(1, 6))}
        total = len(names) * r.randrange(1, 15)
        plan = M.plan_mixture(patterns, targets, total)
        cost, left = cheapest_by_paths(patterns, targets, total)
        assert sum(plan.short.values()) == sum(left.values()) and cost_of(plan, patterns) == cost


def test_costs_rise_without_end():
    """Far beyond 64 uses, the larger repetition still goes to nobody alone."""
    plan = M.plan_mixture({("a",): 1, ("a", "b"): 1}, [target("a", 1, 10**6)], 10**6)
    assert plan.routed[("a",), "a"] == plan.routed[("a", "b"), "a"] == 500_000
    # b takes its share from the shared pattern; what is left of a is spread evenly.
    plan = M.plan_mixture({("a",): 3, ("a", "b"): 3}, [target("a", 0.75, 1000), target("b", 0.25, 1000)], 1200)
    assert plan.routed[("a", "b"), "b"] == 300 and plan.routed[("a",), "a"] == 600 and plan.routed[("a", "b"), "a"] == 300


def test_many_patterns():
    import time

    r = random.Random(3)
    names = [f"s{i:02d}" for i in range(40)]
    patterns = {tuple(sorted(r.sample(names, r.randrange(1, 5)))): r.randrange(1, 10**9) for _ in range(10_000)}
    targets = [M.Target(n, Fr(i + 1, 820), r.choice([1, 4, 100])) for i, n in enumerate(names)]
    began = time.process_time()
    plan = M.plan_mixture(patterns, targets, 3 * sum(patterns.values()))
    assert time.process_time() - began < 60
    for t in targets:
        assert sum((v for (_, s), v in plan.routed.items() if s == t.source), Fr(0)) + plan.short[t.source] == t.share * plan.total


def documents(spark):
    r = random.Random(2)
    rows = []
    for i in range(1500):
        s = r.choice(["wiki"] * 8 + ["WIKI ", "\tqa", "chat", "scratch", None])
        rows.append((i, r.choice([None, ""]) if i % 97 == 0 else " ".join(r.choice(["token", "index", "größe", "12345", "\U0001f600"]) for _ in range(r.randrange(1, 30))), s))
    rows += [(5000, "only one text", "qa"), (5001, "only one text", "chat"), (5001, "only one text", "chat"), (6000, "long " * 30_000, "wiki")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash")), rows


TARGETS = [("wiki", 0.5, 1), ("qa", 0.3, 2), ("chat", 0.2, 3), ("none", 0.0, 1), ("wiki", 0.1, 9), (None, 0.1, 1), ("nothing", None, 1)]


def test_sizes_selection_and_report(spark):
    docs, rows = documents(spark)
    targets = M.read_targets(spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    assert {(t.source, float(t.share), t.max_repeats) for t in targets} == {("wiki", 0.5, 1), ("qa", 0.3, 2), ("chat", 0.2, 3), ("none", 0.0, 1)}
    sized = M.sized_documents(docs, targets).cache()
    encode = M._encoder(M.TOKENIZER).encode_ordinary
    want = {}
    for _, t, s in rows:
        s = s and s.strip().lower()
        if s in ("wiki", "qa", "chat"):
            want[s,] = want.get((s,), 0) + len(encode(t or ""))
    sizes = M.pattern_sizes(sized)
    assert sizes == want
    plan = M.plan_mixture(sizes, targets, sum(sizes.values()))
    used = M.select_documents(sized, plan, seed=3).cache()
    by = {r.source: r for r in M.report_shares(used, targets).collect()}
    biggest = max(r.tokens for r in sized.collect())
    for t in targets:
        routed = plan.routed.get(((t.source,), t.source), 0)
        assert abs(by[t.source].tokens_used - routed) <= biggest and by[t.source].target_share == float(t.share)
    limits = {t.source: t.max_repeats for t in targets}
    assert all(1 <= r.uses <= limits[r.source] for r in used.collect())
    again = M.select_documents(sized.repartition(7), plan, seed=3)
    assert sorted(map(tuple, used.select("doc_id", "uses").collect())) == sorted(map(tuple, again.select("doc_id", "uses").collect()))


def test_decoding_gives_the_text_back():
    e = M._encoder(M.TOKENIZER)
    for t in ("", "a b", "größe \U0001f600 <|endoftext|>", "x" * 10_000):
        assert e.decode(e.encode_ordinary(t)) == t


def test_overlapping_documents(spark):
    docs, _ = documents(spark)
    targets = M.read_targets(spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    rows = M.overlapping_documents(docs, targets).where("doc_id IN (5000, 5001)").collect()
    assert [(r.doc_id, r.pattern) for r in rows] == [(5000, ["chat", "qa"])]
    sized = M.overlapping_documents(docs, targets)
    sizes = M.pattern_sizes(sized)
    used = M.select_documents(sized, M.plan_mixture(sizes, targets, sum(sizes.values())))
    assert all(r.source in r.pattern for r in used.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = [target("a", 1, 2)]
    sized = M.sized_documents(docs, targets)
    plan = M.plan_mixture(M.pattern_sizes(sized), targets, 0)
    assert M.unreachable(plan) == [] and M.select_documents(sized, plan).count() == 0
    assert [r.tokens_used for r in M.report_shares(M.select_documents(sized, plan), targets).collect()] == [0]
    none = M.plan_mixture({}, [], 0)
    assert none.routed == {}


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError):
        M.pattern_sizes(spark.createDataFrame([(["a"], 1), (["b"], 1)], "pattern array<string>, tokens bigint"))

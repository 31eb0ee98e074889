import random

from pyspark.sql import functions as F

from quarrydex.functions.bloom import MIX, fnv1a, mixed, filter_bits
from quarrydex.llm import seen_keys
from quarrydex.streaming.files import stream_table


def brute(history, probes):
    """Probe -> seen, by the definition; null ids come last."""
    order = lambda p: seen_keys.LAST if p[0] is None else p[0]
    return {p: any(h == p[1] for h in history) or any(q[1] == p[1] and order(q) < order(p) for q in probes) for p in probes if p[1] is not None}


def run(spark, path, history, probes, max_files=None, name="", history_files=None):
    spark.createDataFrame([(k,) for k in history], "key string").repartition(2).write.mode("append").parquet(f"{path}/kv_log.parquet")
    df = spark.createDataFrame(probes, "probe_id bigint, key string").withColumn("seen", F.lit("clash")).withColumn("first", F.lit(1))
    df.repartition(3).write.mode("append").parquet(f"{path}/key_probes.parquet")
    own = seen_keys.state_session(spark)
    h = stream_table(own, path, "kv_log", "key string", history_files)
    p = stream_table(own, path, "key_probes", "probe_id bigint, key string", max_files).select("key", seen_keys.order_of("probe_id").alias("probe_order"))
    firsts = seen_keys.first_probes(h, p, f"{path}/state{name}", f"{path}/firsts{name}")
    all_ = spark.read.parquet(f"{path}/key_probes.parquet")
    firsts = seen_keys.last_answers(spark, f"{path}/firsts{name}")
    return seen_keys.mark_probes(all_, firsts)


def data(seed, start=0):
    r = random.Random(seed)
    keys = ["hot", "", "K1", "k1", "k1 ", "01", "1", "é", "é", "x" * 3000, *(f"k{i}" for i in range(60))]
    history = [r.choice([*keys[:30], None]) for _ in range(80)]
    probes = [(start + i, r.choice(["hot"] * 20 + keys + [None])) for i in range(300)]
    probes += [r.choice(probes) for _ in range(10)] + [(None, "only-null-id"), (None, "hot"), (-7, "new-negative"), (5, "new-negative")]
    r.shuffle(probes)
    return history, probes


def marked(df):
    return {(x.probe_id, x.key): x.seen for x in df.collect() if x.key is not None}


def test_against_brute_force(spark, tmp_path):
    history, probes = data(1)
    df = run(spark, str(tmp_path / "a"), history, probes)
    assert df.count() == len(probes) and "first" in df.columns
    assert marked(df) == brute(history, probes)
    assert df.where("key IS NULL AND seen IS NOT NULL").count() == 0


def test_many_batches_and_resuming(spark, tmp_path):
    path = str(tmp_path / "b")
    history, probes = data(2)
    assert marked(run(spark, path, history, probes, max_files=1)) == brute(history, probes)
    more = [(1000 + i, k) for i, k in enumerate(["hot", "brand-new", "brand-new", "k59"])]
    assert marked(run(spark, path, [], more, max_files=1)) == brute(history, probes + more)


def test_history_may_come_late(spark, tmp_path):
    """Both sources one file a micro-batch: history that comes after its key's probe takes the first back."""
    path = str(tmp_path / "late")
    for seed in (3, 4):
        history, probes = data(seed)
        assert marked(run(spark, f"{path}{seed}", history, probes, max_files=1, history_files=1)) == brute(history, probes)
    assert len({r.batch for r in spark.read.parquet(f"{path}4/firsts").select("batch").distinct().collect()}) >= 2
    run(spark, path, ["a"], [(1, "z"), (2, "b"), (3, "a")], history_files=1)
    assert marked(run(spark, path, ["z"], [(4, "b"), (0, "b")], history_files=1)) == brute(["a", "z"], [(1, "z"), (2, "b"), (3, "a"), (4, "b"), (0, "b")])


def test_empty(spark, tmp_path):
    assert run(spark, str(tmp_path / "c"), ["a"], []).count() == 0


def test_wrong_rate(spark):
    probes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)], "probe_id bigint, key string")
    truth = seen_keys.exact_answers(spark.createDataFrame([("b",), (None,)], "key string"), probes)
    right = probes.withColumn("seen", F.expr("CASE WHEN key = 'b' THEN true WHEN key = 'a' THEN probe_id > 1 END"))
    assert tuple(seen_keys.wrong_answers(right, truth).first()) == (4, 3, 1, 0, 0, 0.0)
    wrong = probes.withColumn("seen", F.expr("CASE WHEN key = 'b' THEN false WHEN key = 'a' THEN true END"))
    assert tuple(seen_keys.wrong_answers(wrong, truth).first()) == (4, 2, 2, 1, 2, 0.75)
    assert seen_keys.wrong_answers(right.where("false"), truth.where("false")).first().wrong_rate is None


def reference_hash(s):
    h = 14695981039346656037
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) % 2**64
    m = (h >> 33) ^ (h * MIX % 2**64)
    return h, m or MIX


def test_hashes():
    import pyarrow as pa

    words = ["", "a", "foobar", "größe", "x" * 999]
    h = fnv1a(pa.array(["skipped", *words]).slice(1))
    assert [(int(a), int(b)) for a, b in zip(h, mixed(h))] == [reference_hash(w) for w in words]
    assert reference_hash("foobar")[0] == 0x85944171F73967E8 and filter_bits(0) == 64 and filter_bits(100) == 1000


def test_filter_audit(spark):
    def bits(keys, m):
        words = [0] * ((m + 63) // 64)
        for k in keys:
            for h in reference_hash(k):
                words[h % m // 64] |= 1 << (h % m % 64)
        return [w - 2**64 if w >= 2**63 else w for w in words]

    own = {s: [f"s{s}k{i}" for i in range(200)] for s in range(4)}
    m = filter_bits(200)
    filters = [(0, m, bits(own[0], m)), (1, m, None), (2, m, bits(own[2][:100], m)), (3, m, bits(own[3], m)[:5]), (3, m, bits(own[3], m)[:5]), (None, m, None)]
    f = spark.createDataFrame(filters, "segment_id int, m_bits bigint, bits array<bigint>")
    o = spark.createDataFrame([(s, k) for s, ks in own.items() for k in ks] + [(0, None), (None, "x")], "segment_id int, key string")
    p = spark.createDataFrame([(f"stranger{i}",) for i in range(3000)] + [(None,)], "key string")
    got = {r.segment_id: r for r in seen_keys.audit_filters(f, o, p).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r.own_keys == 200 for r in got.values())
    assert got[0].false_no == got[1].false_no == got[3].false_no == 0 and 60 < got[2].false_no <= 100
    assert 0.01 < got[0].false_maybe / got[0].strangers < 0.07 and got[1].false_maybe == got[1].strangers


def test_filter_audit_asks_every_filter(spark, monkeypatch):
    """Against brute force over all pairs, with ids far apart, probes that segments hold, and several groups and blocks."""
    r = random.Random(5)
    own = {s: [f"k{r.randrange(400)}" for _ in range(30)] for s in (3, 1000, 2_000_000, 2_000_001)}
    probes = [f"k{r.randrange(600)}" for _ in range(300)]
    filters, maybe = [], {}
    for s, ks in own.items():
        m = filter_bits(len(ks)) + 10 * (s % 2)
        on = {h % m for k in ks[: 20 if s == 1000 else None] for h in reference_hash(k)}
        words = [sum(1 << b for b in range(64) if w * 64 + b in on) for w in range((m + 63) // 64)]
        filters.append((s, m, [w - 2**64 if w >= 2**63 else w for w in words]))
        maybe[s] = lambda k, m=m, on=on: all(h % m in on for h in reference_hash(k))
    filters.append((9, 64, [0]))
    maybe[9], own[9] = lambda k: False, []
    want = {
        (s, len(set(ks)), sum(not maybe[s](k) for k in set(ks)), len(set(probes) - set(ks)), sum(maybe[s](k) for k in set(probes) - set(ks)))
        for s, ks in own.items()
    }
    f = spark.createDataFrame(filters, "segment_id int, m_bits bigint, bits array<bigint>")
    o = spark.createDataFrame([(s, k) for s, ks in own.items() for k in ks], "segment_id int, key string")
    p = spark.createDataFrame([(k,) for k in probes], "key string")
    assert {tuple(x) for x in seen_keys.audit_filters(f, o, p).collect()} == want
    monkeypatch.setattr(seen_keys, "MAX_KEYS", 50)
    monkeypatch.setattr(seen_keys, "MAX_BYTES", 100)
    assert {tuple(x) for x in seen_keys.audit_filters(f, o, p).collect()} == want
    assert {x.strangers for x in seen_keys.audit_filters(f, o, p.where("false")).collect()} == {0}

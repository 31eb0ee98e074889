import random

from pyspark.sql import functions as F

from quarrydex.operators import kv
from quarrydex.operators.engine import BooleanIndex, KeyValueStore, PositionalIndex, UnionStore
from quarrydex.operators.index import build_positions
from quarrydex.operators.search import phrase_terms
from quarrydex.sources.segments import FAN, SegmentStore
from quarrydex.streaming.files import stream_table
from quarrydex.streaming.ingest import ingest


def test_put_get_compact(spark, tmp_path):
    s = KeyValueStore(spark, str(tmp_path), max_size=3)
    r, want = random.Random(1), {}
    for i in range(30):
        k, v = f"k{r.randrange(8)}", r.choice([None, b"", f"v{i}".encode()])
        s.put(k, v)
        want[k] = v
    get = lambda x: {f"k{i}": x.get(f"k{i}") for i in range(9)}
    expected = {f"k{i}": want.get(f"k{i}") for i in range(9)}
    assert get(s) == expected
    s.compact()
    assert get(s) == expected
    again = KeyValueStore(spark, str(tmp_path))
    again.put("k0", b"new")
    assert get(again) == expected | {"k0": b"new"}
    live = {x.key: bytes(x.value) for x in again.rows().collect()}
    assert live == {k: v for k, v in (want | {"k0": b"new"}).items() if v is not None}


def test_union_members(spark):
    log = [("a", "x", 1), ("a", "x", 2), ("a", None, 3), ("a", "y", 4), ("b", None, 9), ("b", "z", 8), (None, "q", 1), ("c", "q", None), ("d", "", 1)]
    got = kv.union_members(spark.createDataFrame(log, "key string, member string, seq bigint"))
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("d", "")]


def test_get_key_ties(spark):
    log = spark.createDataFrame([("a", b"x", 5), ("a", b"y", 5), ("b", b"x", 5), ("b", None, 5), ("b", b"z", None)], "key string, value binary, seq bigint")
    assert bytes(kv.get_key(log, "a").first().value) == b"y" and kv.get_key(log, "b").first() is None and kv.get_key(log, "none").first() is None
    newest = {r.key: bytes(r.value) for r in kv.newest_values(log).collect()}
    assert newest == {"a": b"y"}


def terms(store):
    return sorted(r.term for r in store.read().collect())


def fresh(spark, path, **kw):
    return SegmentStore(spark, str(path), "term string, doc_id bigint", **kw)


def one(spark, term):
    return spark.createDataFrame([(term, 1)], "term string, doc_id bigint")


SAME = lambda rows: rows


def test_segment_store(spark, tmp_path):
    s = fresh(spark, tmp_path)
    assert s.read().count() == 0 and s.append(one(spark, "a")) == 0
    assert s.append(one(spark, "b"), "stream", 0) == 1 and s.append(one(spark, "b"), "stream", 0) is None  # a replay
    assert terms(s) == ["a", "b"] and s.batches() == 2
    s.compact(SAME)
    assert terms(s) == ["a", "b"] and len(s.segments()) == 1
    assert s.append(one(spark, "b"), "stream", 0) is None and s.append(one(spark, "c"), "stream", 1) == 2  # also after compaction
    assert terms(s) == terms(fresh(spark, tmp_path)) == ["a", "b", "c"]


def test_append_while_compacting(spark, tmp_path):
    s = fresh(spark, tmp_path)
    s.append(one(spark, "a"))
    s.append(one(spark, "b"))

    def merge(rows):
        fresh(spark, tmp_path).append(one(spark, "late"))
        return rows

    s.compact(merge)
    assert terms(s) == ["a", "b", "late"] and len(s.segments()) == 2


def test_two_compactions_at_once(spark, tmp_path):
    s = fresh(spark, tmp_path)
    s.append(one(spark, "a"))
    s.append(one(spark, "b"))

    def merge(rows):
        fresh(spark, tmp_path).compact(SAME)
        return rows

    s.compact(merge)
    assert terms(s) == ["a", "b"] and len(s.segments()) == 1


def test_two_writers(spark, tmp_path):
    x, y = fresh(spark, tmp_path), fresh(spark, tmp_path)
    n, m = x.reserve(), y.reserve()  # both have taken their numbers before either writes
    assert n != m
    assert x.append(one(spark, "x"), number=n) == n and y.append(one(spark, "y"), number=m) == m
    assert terms(x) == ["x", "y"] and {r.batch_id for r in x.read().collect()} == {n, m}
    stale = x.manifest()
    y.append(one(spark, "z"))
    stale["number"] += 1
    assert not x._publish(stale) and terms(x) == ["x", "y", "z"]  # its number is taken


def test_publishing_by_rename(spark, tmp_path):
    """Other file systems than the local one rename without replacing."""

    class Elsewhere:
        def toUri(self):
            return self

        def getScheme(self):
            return "hdfs"

    s = fresh(spark, tmp_path)
    s._root = Elsewhere()
    assert s.append(one(spark, "a")) == 0 and s.append(one(spark, "b")) == 1
    taken = s.manifest()
    assert not s._publish(taken) and terms(s) == ["a", "b"]
    assert not [f for f in (tmp_path / "manifests").iterdir() if f.name.endswith(".tmp")]


def test_many_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: fresh(spark, tmp_path).append(one(spark, f"t{i:02d}")), range(16)))
    assert sorted(numbers) == list(range(16)) and terms(fresh(spark, tmp_path)) == [f"t{i:02d}" for i in range(16)]


def test_result_held_across_compaction(spark, tmp_path):
    s = fresh(spark, tmp_path)
    s.append(one(spark, "a"))
    held = s.read()
    s.compact(SAME)
    assert [r.term for r in held.collect()] == ["a"]
    assert len(s.manifest()["dropped"]) == 1
    hasty = fresh(spark, tmp_path, retention=0.0)
    hasty.compact(SAME)
    assert hasty.manifest()["dropped"] == [] and terms(hasty) == ["a"]


def test_levels_stay_bounded(spark, tmp_path):
    x = BooleanIndex(spark, str(tmp_path), max_size=1)
    for i in range(16):
        x.add_document(i, f"word{i} shared")
    assert 2 <= len(x.store.segments()) <= FAN + 2 and {s["level"] for s in x.store.segments()} <= {0, 1}
    assert sorted(r.doc_id for r in x.search("shared OR word3").collect()) == list(range(16))


def test_stream_into_a_filled_index(spark, tmp_path):
    x = BooleanIndex(spark, str(tmp_path / "index"))
    x.add_table(spark.createDataFrame([(1, "run"), (2, "bloom")], "doc_id bigint, text string"))
    spark.createDataFrame([(9, "heap")], "doc_id bigint, text string").write.parquet(str(tmp_path / "corpus.parquet"))
    stream = stream_table(spark, str(tmp_path), "corpus", "doc_id bigint, text string")
    ingest(stream, x, str(tmp_path / "a")).awaitTermination()
    assert sorted(r.doc_id for r in x.postings().collect()) == [1, 2, 9]
    x.compact()
    ingest(stream, x, str(tmp_path / "b")).awaitTermination()  # another stream's epoch 0
    assert sorted(r.doc_id for r in x.postings().collect()) == [1, 2, 9] and x.store.batches() == 3


def test_stream_equals_batch(spark, tmp_path, small):
    for i in range(2):  # two runs: the second finds only new files
        rows = spark.read.parquet(f"{small}/corpus.parquet").where(F.pmod("doc_id", F.lit(2)) == i)
        rows.repartition(2).write.mode("append").parquet(str(tmp_path / "corpus.parquet"))
        x = PositionalIndex(spark, str(tmp_path / "index"))
        ingest(stream_table(spark, str(tmp_path), "corpus", "doc_id bigint, text string", max_files=1), x, str(tmp_path / "checkpoint")).awaitTermination()
    assert x.store.batches() >= 2
    want = build_positions(spark.read.parquet(f"{small}/corpus.parquet"))
    got = x.store.read().drop("batch_id").distinct()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert phrase_terms(["slot"], got).count() > 0


def test_union_store(spark, tmp_path):
    s = UnionStore(spark, str(tmp_path), max_size=2)
    r, want = random.Random(3), {}
    for i in range(40):
        k = f"k{r.randrange(5)}"
        if r.random() < 0.15:
            s.delete(k)
            want[k] = set()
        else:
            m = f"m{r.randrange(9)}".encode()
            s.put(k, m, b"")
            want.setdefault(k, set()).update({m, b""})
    got = {k: s.get(k) for k in want}
    s.compact()
    again = UnionStore(spark, str(tmp_path))
    assert got == {k: again.get(k) for k in want} == want
    rows = {}
    for x in again.rows().collect():
        rows.setdefault(x.key, set()).add(bytes(x.member))
    assert rows == {k: v for k, v in want.items() if v} and again.get("never") == set()


def test_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    from quarrydex.session import shared_dir

    try:
        shared_dir(Session, "x")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a machine's own folder was used on a cluster")
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session, "x").startswith("file://")

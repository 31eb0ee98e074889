"""Has this key been seen before? Exact first-or-repeat decisions from a streaming state store.

A stateful streaming aggregation, partitioned by key, keeps one small row per key in
RocksDB: whether the key is in the history, and the first probe that had it. The state lives
on disk, is bounded in memory by RocksDB's shared cache, survives the loss of an executor
through its checkpoint in the shared folder, and never expires (there is no watermark).
Rows are combined per key before they are shuffled to the state, so a hot key costs one row per task.

Each micro-batch emits, for every key it touched that has probes, the state's answer: the first
probe, and whether there is history (then even the first is a repeat). Both only ever move one way,
so an answer that a later batch takes back (its history or an earlier probe came late) is overruled by
that batch's row, and the last answers are exact however files are cut into batches. A probe is a first
if the state names it, else a repeat; rows are matched to the answers by key and id, never gathered by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.functions.bloom import bloom_hashes, unsigned_mod
from quarrydex.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory that RocksDB may take in an executor, for all its state partitions together.
STATE_MEMORY_MB = 256
#: Keys and bytes of filters that meet in a task of the filter audit.
MAX_KEYS, MAX_BYTES = 1_000_000, 32_000_000
#: Order of a probe without id: after all others.
LAST = 2**63 - 1


def state_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MEMORY_MB))
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    return own


def order_of(id_column: str):
    return F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST))


#: What the stream emits for a key: whether it has history, its first probe.
ANSWERS = "key string, old int, first bigint"


def first_probes(history: DataFrame, probes: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Runs the stream until its sources are exhausted; ``key, first`` of the keys without history.

    ``history`` (``key``) and ``probes`` (``key, probe_order``) are streaming DataFrames of a
    :func:`state_session`, cut into micro-batches as their sources say. Run again with the
    same ``checkpoint`` and ``out``, it goes on where it stopped; a micro-batch that is run again replaces what it emitted.
    """
    rows = history.select("key", F.lit(1).alias("old"), F.lit(None).cast("bigint").alias("probe_order")).unionAll(
        probes.select("key", F.lit(0).alias("old"), "probe_order")
    )
    flags = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("old").alias("old"), F.min("probe_order").alias("first"))

    def emit(batch: DataFrame, number: int) -> None:
        batch.where(F.col("first").isNotNull()).select("key", "old", "first").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = flags.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(emit).start()
    query.awaitTermination()
    return last_answers(history.sparkSession, out)


def last_answers(spark: SparkSession, out: str) -> DataFrame:
    """``key, first`` of the keys without history, after everything the stream has emitted."""
    emitted = spark.read.schema(f"{ANSWERS}, batch int").parquet(out)
    return emitted.groupBy("key").agg(F.max("old").alias("old"), F.min("first").alias("first")).where("old = 0").select("key", "first")


def mark_probes(probes: DataFrame, firsts: DataFrame, key: str = "key", probe_id: str = "probe_id") -> DataFrame:
    """``probes`` with a column ``seen``: true for a repeat, false for a first, null without key.

    A probe is a first if it is its key's first probe and the key has no history. Probes that
    share key and id are equal, so both are firsts. The join is on id and key, so that a hot
    key doesn't gather in one task. Probes without id come after all others. Other columns stay as they
    are, except that one named ``seen`` is replaced.
    """
    f = firsts.select(F.col("key").alias("__first_key"), F.col("first").alias("__first"))
    p = probes.drop("seen").withColumn("__order", order_of(probe_id))
    joined = p.join(f, (F.col("__order") == F.col("__first")) & (p[key] == F.col("__first_key")), "left")
    return joined.withColumn("seen", F.when(F.col(key).isNotNull(), F.col("__first").isNull())).drop("__order", "__first", "__first_key")


def exact_answers(history: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe_id, key, seen`` by two batch joins: the yardstick for the rate of wrong answers."""
    known = history.where(F.col("key").isNotNull()).select("key").distinct().withColumn("known", F.lit(True))
    p = probes.where(F.col("key").isNotNull()).select("key", "probe_id", order_of("probe_id").alias("o"))
    first = p.groupBy("key").agg(F.min("o").alias("first")).join(known, "key", "left").where(F.col("known").isNull())
    return (
        p.join(first.select(F.col("key").alias("k"), "first"), (F.col("o") == F.col("first")) & (F.col("key") == F.col("k")), "left")
        .select("probe_id", "key", F.col("first").isNull().alias("seen"))
    )


def wrong_answers(marked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: probes with a key, repeats, firsts, wrong answers of either kind and their rate."""
    both = marked.where(F.col("key").isNotNull()).select("probe_id", "key", "seen", F.lit(1).alias("mine")).unionAll(
        truth.select("probe_id", "key", "seen", F.lit(0).alias("mine"))
    )
    # Rows with the same id and key have the same answer.
    per = both.groupBy("probe_id", "key").agg(
        F.sum("mine").alias("n"), F.max(F.when(F.col("mine") == 1, F.col("seen"))).alias("got"), F.max(F.when(F.col("mine") == 0, F.col("seen"))).alias("want")
    )
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("probes"), n(F.col("got")).alias("repeats"), n(~F.col("got")).alias("firsts"),
        n(F.col("got") & ~F.col("want")).alias("false_repeats"), n(~F.col("got") & F.col("want")).alias("false_firsts"),
    ).withColumn("wrong_rate", F.try_divide(F.col("false_repeats") + F.col("false_firsts"), "probes"))


def _put_to_all(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """``segment_id, asked, maybe``: how many of the hashed ``keys`` each filter was asked and did not deny."""
    first, second = (keys[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    rows = [r for b in filters.to_batches() for r in zip(b["segment_id"].to_pylist(), b["m_bits"].to_pylist(), b["bits"])]
    maybe, at = [], None
    rows.sort(key=lambda r: r[1] or 0)  # filters of equal size share their places
    for _, m, bits in rows:
        if not len(keys) or not m or m < 0 or not bits.is_valid:
            maybe.append(len(keys))
            continue
        if m != at:
            at, i, j = m, (first % np.uint64(m)).view(np.int64), (second % np.uint64(m)).view(np.int64)
        words = bits.values.fill_null(-1).to_numpy(zero_copy_only=False)
        # Places behind the last word are clipped to a bit that is set.
        table = np.append(np.unpackbits(words.view(np.uint8), bitorder="little"), np.uint8(1))
        hits = np.flatnonzero(table.take(i, mode="clip"))
        maybe.append(int(np.count_nonzero(table.take(j.take(hits), mode="clip"))))
    return pa.table({"segment_id": pa.array([r[0] for r in rows], filters.schema.field("segment_id").type), "asked": pa.array([len(keys)] * len(rows), pa.int64()), "maybe": pa.array(maybe, pa.int64())})


def ask_filters(filters: DataFrame, hashed: DataFrame) -> DataFrame:
    """``segment_id, asked, maybe``: every key of ``hashed`` (``h``) put to every filter (``segment_id, m_bits, bits``).

    Keys are cut into blocks of about MAX_KEYS and filters into groups of about MAX_BYTES by
    hash; each block meets each group in one task, and only counts per segment leave it.
    """
    spark = filters.sparkSession
    n_bytes = filters.agg(F.coalesce(F.sum(F.size("bits").cast("bigint") * 8), F.lit(0))).first()[0]
    n_keys = hashed.count()
    groups = max(1, -(-n_bytes // MAX_BYTES))
    blocks = max(1, -(-n_keys // MAX_KEYS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    k = hashed.select(F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"), F.pmod(F.col("h")[1], F.lit(blocks)).alias("block"), each(groups).alias("group"))
    f = filters.select("segment_id", "m_bits", "bits", F.pmod(F.xxhash64("segment_id"), F.lit(groups)).alias("group"), each(blocks).alias("block"))
    cell = (F.col("group") * blocks + F.col("block")).alias("cell")
    schema = f"segment_id {filters.schema['segment_id'].dataType.simpleString()}, asked bigint, maybe bigint"
    counts = k.select(cell, "h1", "h2").groupBy("cell").cogroup(f.select(cell, "segment_id", "m_bits", "bits").groupBy("cell")).applyInArrow(_put_to_all, schema)
    return counts.groupBy("segment_id").agg(F.sum("asked").alias("asked"), F.sum("maybe").alias("maybe"))


def audit_filters(filters: DataFrame, own: DataFrame, probes: DataFrame) -> DataFrame:
    """How often the stored per-segment Bloom filters answer wrongly.

    Every key of a segment must be answered "maybe"; a "no" is counted as ``false_no`` (the
    filter is behind its segment). Each distinct probe key is put to every filter; those that
    aren't in the segment are its ``strangers``, and a "maybe" for one of them counts as
    ``false_maybe``. Filters without bits, and words that are missing, answer "maybe".
    Segments are identified by ``segment_id``; equal ids are one segment, and each that has a
    filter gives a row. For a segment's own keys the bits are joined as single words,
    never as whole filters per key; strangers are counted by :func:`ask_filters`.
    """
    f = filters.where(F.col("segment_id").isNotNull()).dropDuplicates(["segment_id"])
    numbered = f.select("segment_id", "m_bits")
    k = probes.where(F.col("key").isNotNull()).select("key").distinct()
    held = own.where(F.col("key").isNotNull() & F.col("segment_id").isNotNull()).select("segment_id", "key").distinct()
    keys = held.select("key", F.lit(0).alias("probed")).unionAll(k.select("key", F.lit(1))).groupBy("key").agg(F.max("probed").alias("probed"))
    bits = (
        held.join(keys.select("key", "probed", bloom_hashes("key").alias("h")), "key").join(numbered, "segment_id")
        .select("segment_id", "key", "probed", F.explode(F.transform("h", lambda h: unsigned_mod(h, F.col("m_bits")))).alias("bit"))
        .withColumn("word_at", (F.col("bit") / 64).cast("int"))
    )
    words = f.select("segment_id", F.posexplode("bits").alias("word_at", "word"))
    one = F.when(F.col("word").isNull(), 1).otherwise(F.getbit(F.col("word"), (F.col("bit") % 64).cast("int")).cast("int"))
    answers = bits.join(words, ["segment_id", "word_at"], "left").groupBy("segment_id", "key", "probed").agg(F.min(one).alias("maybe"))
    count = lambda c: F.count(F.when(c, 1))
    inside = answers.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("own_keys"),
        count(F.col("maybe") == 0).alias("false_no"),
        count(F.col("probed") == 1).alias("own_asked"),
        count((F.col("probed") == 1) & (F.col("maybe") == 1)).alias("own_maybe"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ask_filters(f, k.select(bloom_hashes("key").alias("h"))).join(inside, "segment_id", "left").select(
        "segment_id", n("own_keys").alias("own_keys"), n("false_no").alias("false_no"),
        (F.col("asked") - n("own_asked")).alias("strangers"), (F.col("maybe") - n("own_maybe")).alias("false_maybe"),
    )


def run_stream(spark: SparkSession, history: DataFrame, probes: DataFrame) -> DataFrame:
    """:func:`first_probes` with new state in the session's shared folder, read back in ``spark``."""
    base = shared_dir(spark, "seen-keys")
    first_probes(history, probes, f"{base}/state", f"{base}/firsts")
    return last_answers(spark, f"{base}/firsts")

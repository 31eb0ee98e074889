"""Queries over the index and its tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.functions.text import raw_words
from quarrydex.operators import bitmaps, index, kv, search
from quarrydex.operators.engine import BooleanIndex, DatedIndex, GramIndex, KeyValueStore, PositionalIndex, UnionStore
from quarrydex.plans.compile import by_scan, by_sets
from quarrydex.plans.language import parse
from quarrydex.session import shared_dir
from quarrydex.sources.tables import table
from quarrydex.streaming.files import stream_table
from quarrydex.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CORPUS = "doc_id bigint, text string, valid_start date, valid_end date, added_at timestamp_ntz"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _add(name: str, f: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = f, sql


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "postings")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tokens")


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return index.build_doc_dates(table(spark, d, "corpus"), F.col("added_at"))


# --- analysis and index building

_IDS = "doc_id BETWEEN 0 AND 4294967295"


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM documents) GROUP BY w")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs in the documents."""
    return table(spark, d, "documents").select(F.explode(raw_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT doc_id, pos, term FROM tokens WHERE term IS NOT NULL")
def positions_build(spark: SparkSession, d: str) -> DataFrame:
    """The positional index of the corpus: words, stop words, stems, positions."""
    return index.build_positions(table(spark, d, "corpus"), F.col("added_at"))


@query("SELECT DISTINCT term, doc_id FROM tokens WHERE term IS NOT NULL")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    """The boolean index of the corpus."""
    return index.build_postings(table(spark, d, "corpus"))


@query("SELECT DISTINCT term FROM postings WHERE term IS NOT NULL")
def vocabulary_build(spark: SparkSession, d: str) -> DataFrame:
    return index.build_vocabulary(_postings(spark, d))


@query("SELECT DISTINCT gram, term FROM kgrams")
def kgrams_build(spark: SparkSession, d: str) -> DataFrame:
    """The 3-gram index of the vocabulary."""
    return index.build_kgrams(index.build_vocabulary(_postings(spark, d)))


_DATES = f"""ranked AS (SELECT doc_id, valid_start, valid_end, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, valid_start DESC NULLS LAST, valid_end DESC NULLS LAST) AS i FROM corpus WHERE {_IDS}),
dates AS (SELECT doc_id, valid_start, valid_end FROM ranked WHERE i = 1)"""


@query(f"WITH {_DATES} SELECT * FROM dates")
def doc_dates_build(spark: SparkSession, d: str) -> DataFrame:
    """Each record's dates as last added."""
    return _dates(spark, d)


@query("SELECT term, doc_id, list_sort(list(DISTINCT pos)) AS positions FROM tokens WHERE term IS NOT NULL GROUP BY ALL")
def positional_postings(spark: SparkSession, d: str) -> DataFrame:
    """Packed positions of each term and record."""
    return index.pack_positions(_tokens(spark, d).where("term IS NOT NULL"))


@query("SELECT term, count(DISTINCT doc_id) AS n FROM postings WHERE term IS NOT NULL GROUP BY term")
def packed_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    """Records per term, from packed bitmaps."""
    return bitmaps.cardinalities(bitmaps.pack_postings(_postings(spark, d)))


# --- boolean search

_HAS = "(SELECT doc_id FROM postings WHERE term = '{}')"


def _boolean(text: str, where: str) -> tuple[Query, str]:
    sql = f"WITH h AS (SELECT doc_id, list(DISTINCT term) AS t FROM postings WHERE term IS NOT NULL GROUP BY doc_id) SELECT doc_id FROM h WHERE {where}"
    return lambda spark, d: search.search(text, _postings(spark, d)), sql


def _h(term: str) -> str:
    return f"list_contains(t, '{term}')"


_add("bool_and", *_boolean("run AND log", f"{_h('run')} AND {_h('log')}"))
_add("bool_or", *_boolean("bloom or DISK", f"{_h('bloom')} OR {_h('disk')}"))
_add("bool_nested", *_boolean("(run OR bloom) AND (bitmap OR (heap AND segment))", f"({_h('run')} OR {_h('bloom')}) AND ({_h('bitmap')} OR ({_h('heap')} AND {_h('segment')}))"))
_add("bool_precedence", *_boolean("compact OR shard AND bloom", f"{_h('compact')} OR ({_h('shard')} AND {_h('bloom')})"))
_add("bool_stemmed", *_boolean("Running AND (Snapshots OR segments)", f"{_h('run')} AND ({_h('snapshot')} OR {_h('segment')})"))
_add("bool_stop_word_and", *_boolean("run AND the", "false"))
_add("bool_stop_word_or", *_boolean("bitmap OR the", _h("bitmap")))

NESTED = "(run OR bloom) AND (bitmap OR (heap AND segment))"


@query(ORACLE["bool_nested"])
def bool_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """The nested query by intersections and unions."""
    return by_sets(parse(NESTED), _postings(spark, d).select("term", "doc_id"))


@query(ORACLE["bool_nested"])
def bool_scan(spark: SparkSession, d: str) -> DataFrame:
    """The nested query over raw records, without an index."""
    return by_scan(parse(NESTED), index.analyzed(table(spark, d, "corpus")))


@query("SELECT doc_id FROM postings WHERE term = 'run' EXCEPT SELECT doc_id FROM postings WHERE term = 'log'")
def posting_difference(spark: SparkSession, d: str) -> DataFrame:
    """Records with one term but not another."""
    return search.difference(search.search("run", _postings(spark, d)), search.search("log", _postings(spark, d)))


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM postings WHERE term = 'run' INTERSECT SELECT doc_id FROM postings WHERE term = 'log')")
def bitmap_and_count(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.count_all(bitmaps.pack_postings(_postings(spark, d).where(F.col("term").isin("run", "log"))), ["run", "log"])


@query("SELECT count(DISTINCT doc_id) AS n FROM postings WHERE term IN ('bloom', 'disk')")
def bitmap_or_count(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.count_any(bitmaps.pack_postings(_postings(spark, d).where(F.col("term").isin("bloom", "disk"))), ["bloom", "disk"])


# --- prefix and wildcard search


def _like(pattern: str) -> str:
    return f"SELECT DISTINCT doc_id FROM postings WHERE term LIKE '{pattern}'"


def _wild(pattern: str) -> Query:
    return lambda spark, d: search.search_wildcard(pattern, _postings(spark, d))


_add("prefix_search", lambda spark, d: search.search_prefix("Snap", _postings(spark, d)), _like("snap%"))
_add("prefix_short", lambda spark, d: search.search_prefix("q", _postings(spark, d)), _like("q%"))
_add("prefix_kgrams", lambda spark, d: search.search_prefix_by_kgrams("qi", table(spark, d, "kgrams"), _postings(spark, d)), _like("qi%"))
_add("wildcard_suffix", _wild("*om"), _like("%om"))
_add("wildcard_infix", _wild("*hi*"), _like("%hi%"))
_add("wildcard_inner", _wild("s*t"), _like("s%t"))
_add("wildcard_star", _wild("*"), "SELECT DISTINCT doc_id FROM postings WHERE term IS NOT NULL")
_add("wildcard_literal", _wild("snapshot"), "SELECT DISTINCT doc_id FROM postings WHERE term = 'snapshot'")
_add("wildcard_kgrams", lambda spark, d: search.search_wildcard_by_kgrams("*aki*o*", table(spark, d, "kgrams"), _postings(spark, d)), _like("%aki%o%"))


@query("SELECT term FROM kgrams WHERE gram IN ('eub', 'ub$') GROUP BY term HAVING count(DISTINCT gram) = 2")
def kgram_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Terms that have all of several grams."""
    return search.kgram_candidates(["eub", "ub$"], table(spark, d, "kgrams"))


# --- phrases


def _phrase(text: str, terms: list[str]) -> tuple[Query, str]:
    t = ["(SELECT DISTINCT doc_id, pos FROM tokens WHERE term = '%s') t%d" % (x, i) for i, x in enumerate(terms)]
    on = "".join(f" JOIN {x} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i}" for i, x in enumerate(t) if i)
    return lambda spark, d: search.search_phrase(text, _tokens(spark, d)), f"SELECT DISTINCT t0.doc_id FROM {t[0]}{on}"


_add("phrase_single", *_phrase("Snapshots", ["snapshot"]))
_add("phrase_two", *_phrase("slot prefix", ["slot", "prefix"]))
_add("phrase_three", *_phrase("run slot segment", ["run", "slot", "segment"]))
_add("phrase_repeated", *_phrase("slot slot", ["slot", "slot"]))
_add("phrase_stop_word_gap", *_phrase("the running of segments", ["run", "segment"]))
_add("phrase_unknown", *_phrase("slot zzzunknown", ["slot", "zzzunknown"]))


@query(ORACLE["phrase_two"])
def phrase_scan(spark: SparkSession, d: str) -> DataFrame:
    """A phrase over raw records, without an index."""
    return search.phrase_scan("slot prefix", index.analyzed(table(spark, d, "corpus")))


# --- days

_A, _B = dt.date(2016, 1, 1), dt.date(2018, 6, 30)
_APPEARED = "valid_start BETWEEN DATE '2016-01-01' AND DATE '2018-06-30'"
_VALID = "valid_start <= DATE '2018-06-30' AND (valid_end IS NULL OR valid_end >= DATE '2016-01-01')"


def _dated(text: str) -> Query:
    return lambda spark, d: search.search_dated(text, _postings(spark, d), _dates(spark, d))


_add("date_appeared", lambda spark, d: search.appeared_in_range(_dates(spark, d), _A, _B), f"WITH {_DATES} SELECT doc_id FROM dates WHERE {_APPEARED}")
_add("date_reversed_bounds", lambda spark, d: search.appeared_in_range(_dates(spark, d), _B, _A), ORACLE["date_appeared"])
_add("date_valid_open_end", lambda spark, d: search.valid_in_range(_dates(spark, d), _A, _B), f"WITH {_DATES} SELECT doc_id FROM dates WHERE {_VALID}")
_add("date_and_term", _dated("bloom AND VALID[2016-01-01,2018-06-30]"), f"WITH {_DATES} SELECT doc_id FROM dates WHERE {_VALID} AND doc_id IN {_HAS.format('bloom')}")
_add("date_or_term", _dated("bitmap OR [2016-01-01,2018-06-30]"), f"WITH {_DATES} SELECT doc_id FROM dates WHERE {_APPEARED} OR doc_id IN {_HAS.format('bitmap')}")
_add(
    "date_mixed",
    _dated("(run AND date[2018-06-30,2016-01-01]) OR (disk AND APPEARED[2019-01-01,2019-12-31])"),
    f"WITH {_DATES} SELECT doc_id FROM dates WHERE {_APPEARED} AND doc_id IN {_HAS.format('run')} OR valid_start BETWEEN DATE '2019-01-01' AND DATE '2019-12-31' AND doc_id IN {_HAS.format('disk')}",
)


@query("SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-10' AND DATE '1996-11-02'")
def bit_sliced_range(spark: SparkSession, d: str) -> DataFrame:
    """A day range by bit planes."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").where(bitmaps.sliced_range(day, dt.date(1995, 3, 10), dt.date(1996, 11, 2))).agg(F.count(F.lit(1)).alias("n"))


# --- key/value

_LIVE = """SELECT key, max(seq) AS seq, hex(arg_max(value, seq)) AS value_hex FROM (SELECT *, coalesce(value, ''::BLOB) AS v FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL)
{} GROUP BY key HAVING arg_max(value IS NOT NULL, seq)"""


@query(_LIVE.format(""))
def kv_newest(spark: SparkSession, d: str) -> DataFrame:
    """Live keys with their newest value."""
    return kv.newest_values(table(spark, d, "kv_log")).select("key", "seq", F.hex("value").alias("value_hex"))


@query(_LIVE.format("WHERE key = 'snapshot'"))
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    """One key's newest value."""
    return kv.get_key(table(spark, d, "kv_log"), "snapshot").select("key", "seq", F.hex("value").alias("value_hex"))


@query("""WITH c AS (SELECT * FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL),
g AS (SELECT key, max(seq) AS gone FROM c WHERE value IS NULL GROUP BY key)
SELECT c.key, count(DISTINCT value) AS members FROM c LEFT JOIN g ON c.key = g.key WHERE value IS NOT NULL AND seq > coalesce(gone, -1) GROUP BY c.key""")
def kv_union(spark: SparkSession, d: str) -> DataFrame:
    """Members per key when puts add to a set and tombstones clear it."""
    return kv.union_members(table(spark, d, "kv_log"), "value").groupBy("key").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_event, max(event_id) AS seq FROM events GROUP BY user_id")
def kv_events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, by replay of the events."""
    from quarrydex.operators.changefeed import replay_changes

    states = replay_changes(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"], F.lit(False))
    return states.select("user_id", F.col("event_type").alias("last_event"), "seq")


# --- index objects, segments and streams: answers after flushes, compactions and reopening

_OLD = dt.datetime(2018, 1, 1)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The corpus by arrival: what came before a day, and the rest. ``version`` orders repeated records."""
    corpus = table(spark, d, "corpus").withColumn("version", F.col("added_at"))
    old = F.coalesce(F.col("added_at") < F.lit(_OLD), F.lit(False))
    return corpus.where(old), corpus.where(~old)


def _in_two(cls, spark: SparkSession, d: str, compact: bool = True):
    """An index object filled in two batches, compacted, and opened again."""
    path = shared_dir(spark, "index")
    first = cls(spark, path)
    for half in _halves(spark, d):
        first.add_table(half)
    if compact:
        first.compact()
    return cls(spark, path)


@query(ORACLE["postings_build"])
def append_and_compact(spark: SparkSession, d: str) -> DataFrame:
    """The boolean index appended in two batches by arrival and compacted."""
    return _in_two(BooleanIndex, spark, d).postings()


@query(ORACLE["bool_nested"])
def boolean_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The nested query through the index object, after compaction and reopening."""
    return _in_two(BooleanIndex, spark, d).search(NESTED)


@query(ORACLE["bool_and"])
def boolean_index_segments(spark: SparkSession, d: str) -> DataFrame:
    """A boolean query over two segments that were not compacted."""
    return _in_two(BooleanIndex, spark, d, compact=False).search("run AND log")


@query(_like("%aki%o%"))
def gram_index_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """A wildcard through the stored k-grams of the index object."""
    return _in_two(GramIndex, spark, d).search_wildcard("*aki*o*")


@query(_like("snap%"))
def gram_index_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A prefix through the index object."""
    return _in_two(GramIndex, spark, d, compact=False).search_prefix("Snap")


# Of a record in both halves the later half's dates count, of one half the newest.
_DATES2 = f"""ranked2 AS (SELECT doc_id, valid_start, valid_end, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(added_at < TIMESTAMP '2018-01-01', false), added_at DESC NULLS LAST, valid_start DESC NULLS LAST, valid_end DESC NULLS LAST) AS i FROM corpus WHERE {_IDS}),
dates AS (SELECT doc_id, valid_start, valid_end FROM ranked2 WHERE i = 1)"""
_MIXED = f"SELECT doc_id FROM dates WHERE {_VALID} AND doc_id IN {_HAS.format('bloom')}"


@query(f"WITH {_DATES2} {_MIXED}")
def dated_index_search(spark: SparkSession, d: str) -> DataFrame:
    """A query with days through the index object, after compaction and reopening."""
    return _in_two(DatedIndex, spark, d).search("bloom AND VALID[2016-01-01,2018-06-30]")


@query(f"WITH {_DATES2} {_MIXED}")
def dated_index_segments(spark: SparkSession, d: str) -> DataFrame:
    """The same over segments that were not compacted."""
    return _in_two(DatedIndex, spark, d, compact=False).search("bloom AND VALID[2016-01-01,2018-06-30]")


@query(ORACLE["phrase_two"])
def positional_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase through the index object, after compaction and reopening."""
    path = shared_dir(spark, "index")
    PositionalIndex(spark, path).add_table(table(spark, d, "corpus").withColumn("version", F.col("added_at")))
    PositionalIndex(spark, path).compact()
    return PositionalIndex(spark, path).search_phrase("slot prefix")


@query(ORACLE["postings_build"])
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The boolean index built by a stream over the corpus files."""
    base = shared_dir(spark, "ingest")
    target = BooleanIndex(spark, f"{base}/index")
    ingest(stream_table(spark, d, "corpus", CORPUS, max_files=8), target, f"{base}/checkpoint").awaitTermination()
    return target.postings()


@query("SELECT DISTINCT term, doc_id FROM postings WHERE term IS NOT NULL UNION SELECT 'quarri', 4294967295")
def ingest_into_filled_store(spark: SparkSession, d: str) -> DataFrame:
    """A stream into an index that holds rows, is compacted, and is streamed into again."""
    base = shared_dir(spark, "ingest")
    target = BooleanIndex(spark, f"{base}/index")
    target.add_document(2**32 - 1, "quarries")
    target.add_table(_halves(spark, d)[0])
    corpus = stream_table(spark, d, "corpus", CORPUS, max_files=8)
    ingest(corpus, target, f"{base}/checkpoint").awaitTermination()
    target.compact()
    ingest(corpus, target, f"{base}/checkpoint").awaitTermination()
    return BooleanIndex(spark, f"{base}/index").postings()


def _kv_store(spark: SparkSession, d: str) -> KeyValueStore:
    """``kv_log`` in a store, then some single puts and deletes, compacted and opened again."""
    path = shared_dir(spark, "store")
    store = KeyValueStore(spark, path)
    store.put_table(table(spark, d, "kv_log"))
    store.put("snapshot", b"")
    store.put("quarry", b"new")
    store.flush()
    store.put("quarry", None)
    store.put("shard", b"again")
    store.compact()
    return KeyValueStore(spark, path)


_KV = """WITH own AS (SELECT * FROM (VALUES ('snapshot', ''), ('shard', '616761696E')) v(key, value_hex)),
logged AS (SELECT key, hex(arg_max(value, seq)) AS value_hex FROM (SELECT key, seq, coalesce(value, ''::BLOB) AS value, value IS NOT NULL AS live FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL) GROUP BY key HAVING arg_max(live, seq)),
s AS (SELECT * FROM own UNION ALL SELECT * FROM logged WHERE key NOT IN (SELECT key FROM own) AND key <> 'quarry') """


@query(_KV + "SELECT * FROM s")
def kv_store_rows(spark: SparkSession, d: str) -> DataFrame:
    """All live keys of a store that took a table and single puts."""
    return _kv_store(spark, d).rows().select("key", F.hex("value").alias("value_hex"))


@query(_KV + "SELECT k.key, value_hex FROM (VALUES ('snapshot'), ('shard'), ('quarry'), ('never put')) k(key) LEFT JOIN s ON k.key = s.key")
def kv_store_get(spark: SparkSession, d: str) -> DataFrame:
    """Single keys of that store."""
    store = _kv_store(spark, d)
    found = [(k, store.get(k)) for k in ("snapshot", "shard", "quarry", "never put")]
    return spark.createDataFrame([(k, None if v is None else v.hex().upper()) for k, v in found], "key string, value_hex string")


@query("""SELECT key, count(DISTINCT member) AS members FROM (
SELECT term AS key, doc_id::VARCHAR AS member FROM postings WHERE term <> 'bloom' UNION ALL SELECT 'run', 'x' UNION ALL SELECT 'bloom', 'y') WHERE key IS NOT NULL AND member IS NOT NULL GROUP BY key""")
def kv_store_union(spark: SparkSession, d: str) -> DataFrame:
    """Members per key of a store of sets: postings, then single puts and a delete, compacted and opened again."""
    path = shared_dir(spark, "store")
    store = UnionStore(spark, path)
    store.put_table(_postings(spark, d).select(F.col("term").alias("key"), F.col("doc_id").cast("string").cast("binary").alias("member")))
    store.put("run", b"x")
    store.put("bloom", b"gone with the rest")
    store.delete("bloom")
    store.put("bloom", b"y")
    store.compact()
    return UnionStore(spark, path).rows().groupBy("key").agg(F.count(F.lit(1)).alias("members"))

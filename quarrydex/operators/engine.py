"""Index objects: add records, search, compact. The searches themselves are in :mod:`.search`.

Single records are held in memory until ``max_size`` of them wait (or ``flush``), then
become a segment; searches see both at once. Whole tables go straight into a segment.
Levels of segments are merged as they fill up. Where a store is one segment and nothing is
pending, searches read it as it is; else they first merge what its batches say.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydex.functions.text import analyze_text, normalize_pattern
from quarrydex.operators import index, search
from quarrydex.operators.changefeed import live_rows, replay_changes
from quarrydex.operators.kv import get_key, union_members
from quarrydex.sources.segments import SegmentStore

RECORD = "doc_id bigint, text string, valid_start date, valid_end date, version bigint"


def _version(corpus: DataFrame):
    return F.col("version") if "version" in corpus.columns else None


class Index:
    """Shared by all indexes: pending records and the segments of the index tables."""

    table = "term string, doc_id bigint"
    sort = ["term", "doc_id"]

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1024) -> None:
        self.spark, self.max_size, self.pending = spark, max_size, []
        self.store = SegmentStore(spark, f"{path}/postings", self.table, self.sort)

    def _add(self, doc_id: int, text: str, start: dt.date | None = None, end: dt.date | None = None) -> None:
        self.pending.append((doc_id, text, start, end))
        if len(self.pending) >= self.max_size:
            self.flush()

    def add_document(self, doc_id: int, text: str) -> None:
        """Adds one record; ids outside 0..2^32-1 are ignored."""
        self._add(doc_id, text)

    def add_table(self, corpus: DataFrame) -> None:
        """Adds all records of ``doc_id, text`` (and dates) as one batch, after those pending.

        Of records that stand in it more than once, the one with the largest ``version`` counts as the last, if there is such a column.
        """
        self.flush()
        self.write(corpus)

    def flush(self) -> None:
        if self.pending:
            waiting, self.pending = self._waiting(), []
            self.write(waiting)

    def write(self, corpus: DataFrame, source: str | None = None, epoch: int = 0) -> None:
        """One batch of records; a stream's epoch that is already in adds nothing."""
        for store, build, merge in self._parts():
            store.append(build(corpus), source, epoch)
            store.tidy(merge)

    def compact(self) -> None:
        """Merges all segments into one sorted segment."""
        self.flush()
        for store, _, merge in self._parts():
            store.compact(merge)

    def _parts(self) -> list[tuple]:
        """Each table's store, how its rows are built from records, and what a reader keeps of several batches (with ``batch_id``)."""
        return [(self.store, self._build, self._merge)]

    def _waiting(self) -> DataFrame:
        """Pending records; a record may have been added twice."""
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(self.pending)], RECORD)

    def _build(self, corpus: DataFrame) -> DataFrame:
        return index.build_postings(corpus)

    def _merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("term", "doc_id").agg(F.max("batch_id").alias("batch_id"))

    def _rows(self, store: SegmentStore, build, merge, keep=None) -> DataFrame:
        """What the store and the pending records hold, merged if need be; ``keep`` filters rows first."""
        rows, apart = store.read(), len(store.segments()) > 1 or bool(self.pending)
        if self.pending:
            rows = rows.unionByName(build(self._waiting()).withColumn("batch_id", F.lit(2**62)))
        rows = rows if keep is None else rows.where(keep)
        return (merge(rows) if apart else rows).drop("batch_id")


class BooleanIndex(Index):
    """Boolean keyword search."""

    def _all(self) -> DataFrame:
        """Postings, some perhaps repeated; searches don't mind."""
        return self._rows(self.store, self._build, lambda rows: rows)

    def postings(self) -> DataFrame:
        return self._rows(*self._parts()[0])

    def search(self, query: str) -> DataFrame:
        return search.search(query, self._all())


class GramIndex(BooleanIndex):
    """Boolean, prefix and wildcard search; the vocabulary is stored as k-grams beside the postings."""

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1024) -> None:
        super().__init__(spark, path, max_size)
        self.grams = SegmentStore(spark, f"{path}/kgrams", "gram string, term string", ["gram", "term"])

    def _parts(self) -> list[tuple]:
        grams = lambda corpus: index.build_kgrams(index.build_vocabulary(index.build_postings(corpus)))
        merge = lambda rows: rows.groupBy("gram", "term").agg(F.max("batch_id").alias("batch_id"))
        return [*super()._parts(), (self.grams, grams, merge)]

    def kgrams(self) -> DataFrame:
        return self._rows(*self._parts()[1])

    def search_prefix(self, prefix: str) -> DataFrame:
        """By the prefix itself: postings are sorted by term, so that it selects row groups."""
        return search.search_prefix(prefix, self._all())

    def write(self, corpus: DataFrame, source: str | None = None, epoch: int = 0) -> None:
        (store, build, merge), (grams, build_grams, merge_grams) = self._parts()
        n = store.append(build(corpus), source, epoch)
        # The batch's terms are read back, so that texts are analyzed once; a replay may have lost them only after the first append.
        written = build(corpus) if n is None else store.read().where(F.col("batch_id") == n)
        grams.append(index.build_kgrams(index.build_vocabulary(written)), source, epoch)
        store.tidy(merge)
        grams.tidy(merge_grams)

    def search_wildcard(self, pattern: str) -> DataFrame:
        """A pattern that begins with letters selects row groups of postings; any other goes through the k-grams."""
        if not normalize_pattern(pattern).startswith("*") or not normalize_pattern(pattern).strip("*"):
            return search.search_wildcard(pattern, self._all())
        store, build, _ = self._parts()[1]
        return search.search_wildcard_by_kgrams(pattern, self._rows(store, build, lambda rows: rows), self._all())


class DatedIndex(BooleanIndex):
    """Boolean search with day ranges; a record's dates are those it was last added with."""

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1024) -> None:
        super().__init__(spark, path, max_size)
        self.dates = SegmentStore(spark, f"{path}/dates", "doc_id bigint, valid_start date, valid_end date", ["doc_id"])

    def add_document(self, doc_id: int, text: str, valid_start: dt.date, valid_end: dt.date | None = None) -> None:  # type: ignore[override]
        self._add(doc_id, text, valid_start, valid_end)

    def _parts(self) -> list[tuple]:
        return [*super()._parts(), (self.dates, lambda corpus: index.build_doc_dates(corpus, _version(corpus)), self._newest)]

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("valid_start", "valid_end"), "batch_id")
        return rows.groupBy("doc_id").agg(last.alias("d"), F.max("batch_id").alias("batch_id")).select("doc_id", "d.valid_start", "d.valid_end", "batch_id")

    def doc_dates(self) -> DataFrame:
        return self._rows(*self._parts()[-1])

    def search(self, query: str) -> DataFrame:
        return search.search_dated(query, self._all(), self.doc_dates())

    def search_appeared_in_range(self, a: dt.date, b: dt.date) -> DataFrame:
        return search.appeared_in_range(self.doc_dates(), a, b)

    search_date_in_range = search_appeared_in_range

    def search_valid_in_range(self, a: dt.date, b: dt.date) -> DataFrame:
        return search.valid_in_range(self.doc_dates(), a, b)


class PositionalIndex(Index):
    """Exact phrase search. A record added again replaces its positions per term."""

    table = "doc_id bigint, pos int, term string"
    sort = ["term", "doc_id", "pos"]

    def _build(self, corpus: DataFrame) -> DataFrame:
        return index.build_positions(corpus, _version(corpus))

    def _merge(self, rows: DataFrame) -> DataFrame:
        newest = F.max("batch_id").over(Window.partitionBy("term", "doc_id"))
        return rows.withColumn("newest", newest).where(F.col("batch_id") == F.col("newest")).drop("newest").distinct()

    def positions(self) -> DataFrame:
        return self._rows(*self._parts()[0])

    def search_phrase(self, phrase: str) -> DataFrame:
        terms = analyze_text(phrase)
        if not terms:
            raise ValueError("empty phrase")
        # Only the phrase's terms are merged.
        return search.phrase_terms(terms, self._rows(*self._parts()[0], keep=F.col("term").isin(terms)))


class KeyValueStore:
    """Puts, gets and compaction; a null value deletes, the newest put wins.

    Puts wait in memory, one a key, until more than ``max_size`` keys wait; each flush is a
    batch whose reserved number is the sequence of its puts, so that stores opened twice agree on the order.
    """

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1000) -> None:
        self.spark, self.max_size = spark, max_size
        self.pending: dict[str, bytes | None] = {}
        self.store = SegmentStore(spark, f"{path}/kv", "key string, value binary, seq bigint", ["key", "seq"])

    def put(self, key: str, value: bytes | None) -> None:
        self.pending[key] = value
        if len(self.pending) > self.max_size:
            self.flush()

    def put_table(self, log: DataFrame) -> None:
        """Applies a whole table of puts ``key, value, seq``, after those pending; of a key's rows the one with the largest ``seq`` counts."""
        self.flush()
        self._append(self._newest(log))

    def flush(self) -> None:
        if self.pending:
            waiting, self.pending = self.pending, {}
            self._append(self.spark.createDataFrame(list(waiting.items()), "key string, value binary"))

    def _append(self, puts: DataFrame) -> None:
        n = self.store.reserve()
        self.store.append(puts.select("key", "value", F.lit(n).cast("bigint").alias("seq")), number=n)
        self.store.tidy(self._merge)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return replay_changes(rows, ["key"], "seq", ["value"], F.col("value").isNull())

    def _merge(self, rows: DataFrame) -> DataFrame:
        """Each key's newest change; deleted keys stay deleted."""
        return self._newest(rows).select("key", "value", "seq", F.col("seq").alias("batch_id"))

    def get(self, key: str) -> bytes | None:
        """The newest value; None for a key that is deleted or was never put."""
        if key in self.pending:
            return self.pending[key]
        row = get_key(self.store.read(), key).first()
        return None if row is None else bytes(row.value)

    def rows(self) -> DataFrame:
        """``key, seq, value`` of all live keys."""
        self.flush()
        return live_rows(self._newest(self.store.read())).select("key", "seq", "value")

    def compact(self) -> None:
        self.flush()
        self.store.compact(self._merge)


class UnionStore:
    """A key/value store whose values are sets: a put adds members to those the key has, a delete clears them.

    A flush with number n writes its deletes as sequence 2n and its members as 2n + 1. Batches are
    merged by union, member by member, so that a key with many members is never held in one row.
    """

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1000) -> None:
        self.spark, self.max_size = spark, max_size
        self.pending: dict[str, tuple[bool, dict[bytes, None]]] = {}  # deleted first, members put since
        self.store = SegmentStore(spark, f"{path}/sets", "key string, member binary, seq bigint", ["key", "member"])

    def put(self, key: str, *members: bytes) -> None:
        self.pending.setdefault(key, (False, {}))[1].update(dict.fromkeys(members))
        self._check()

    def delete(self, key: str) -> None:
        self.pending[key] = (True, {})
        self._check()

    def _check(self) -> None:
        if len(self.pending) > self.max_size:
            self.flush()

    def put_table(self, rows: DataFrame) -> None:
        """Adds all members of ``key, member``, after those pending; a null member is none."""
        self.flush()
        self._append(rows.where(F.col("key").isNotNull() & F.col("member").isNotNull()).select("key", "member", F.lit(1).alias("after")).distinct())

    def flush(self) -> None:
        if self.pending:
            waiting, self.pending = self.pending, {}
            rows = [(k, None, 0) for k, (gone, _) in waiting.items() if gone] + [(k, m, 1) for k, (_, ms) in waiting.items() for m in ms]
            self._append(self.spark.createDataFrame(rows, "key string, member binary, after int"))

    def _append(self, rows: DataFrame) -> None:
        n = self.store.reserve()
        self.store.append(rows.select("key", "member", (F.col("after") + 2 * n).cast("bigint").alias("seq")), number=n)
        self.store.tidy(self._merge)

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        """Each member's newest put and each key's newest delete, without members put before it."""
        newest = rows.groupBy("key", "member").agg(F.max("seq").alias("seq"), F.max("batch_id").alias("batch_id"))
        gone = newest.where(F.col("member").isNull()).select(F.col("key").alias("gone_key"), F.col("seq").alias("gone"))
        kept = newest.join(gone, F.col("key") == F.col("gone_key"), "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")) | F.col("member").isNull())
        return kept.select("key", "member", "seq", "batch_id")

    def get(self, key: str) -> set[bytes]:
        """The key's members; none for a key that was deleted or never put."""
        gone, members = self.pending.get(key, (False, {}))
        stored = [] if gone else union_members(self.store.read().where(F.col("key") == key)).collect()
        return {bytes(r.member) for r in stored} | set(members)

    def rows(self) -> DataFrame:
        """``key, member`` of all keys."""
        self.flush()
        return union_members(self.store.read())

    def compact(self) -> None:
        self.flush()
        self.store.compact(self._merge)

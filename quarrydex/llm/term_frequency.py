"""Occurrence and record counts of every term (burst-trie counting).

Terms are first reduced to one row per (record, term), which makes record counts exact
whatever task a row is in. Every task then counts its terms in burst tries: an access
trie over bytes whose leaves are small containers (suffix -> two counters); a leaf that
outgrows its capacity bursts into a node with one leaf per next byte, so that prefixes grow
only where terms are dense. Tasks send their tries as subtrees, cut at adaptive prefixes, front-coded
into compact blobs; subtrees of the same prefix meet in one task and are merged one by one.

The routing prefixes are the same for all tasks. By counts over all distinct terms, a prefix of more than
``ROUTE_WEIGHT`` terms is lengthened past the bytes that all its terms share, again and again until no
prefix holds more, so that terms with a long common beginning spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.session import shared_dir

#: Suffixes that a leaf holds before it bursts.
CAPACITY = 512
#: Distinct terms above which a prefix is lengthened, and how many prefixes of so many terms there may be (beyond, they hold more terms each).
ROUTE_WEIGHT, MAX_ROUTES = 20_000, 50_000
#: Distinct terms a task holds before it sends its trie on and starts another.
TASK_TERMS = 500_000


class BurstTrie:
    """Two counters per byte string. ``root`` maps a first byte to a leaf (dict) or a node (list of leaf/node by byte)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.root, self.size = capacity, {}, 0

    def add(self, term: bytes, occurrences: int, records: int) -> None:
        """Adds to the term's counters."""
        at, slot, i = self.root_holder, 0, 0
        while True:
            here = at[slot]
            if type(here) is dict:
                break
            if i == len(term):  # the term ends at this node
                at, slot = here, 256
                here = at[256]
                break
            at, slot, i = here, term[i], i + 1
        rest = term[i:]
        counts = here.get(rest)
        if counts is not None:
            counts[0] += occurrences
            counts[1] += records
            return
        here[rest] = [occurrences, records]
        self.size += 1
        if len(here) > self.capacity and slot != 256:
            at[slot] = self._burst(here)

    @property
    def root_holder(self) -> list:
        if not isinstance(self.root, list):
            self.root = [self.root]
        return self.root

    def _burst(self, leaf: dict) -> list:
        node: list = [None] * 257
        for b in range(257):
            node[b] = {}
        for rest, counts in leaf.items():
            if rest:
                node[rest[0]][rest[1:]] = counts
            else:
                node[256][b""] = counts
        return node

    def items(self, prefix: bytes = b"", at: object = None) -> Iterator[tuple[bytes, list[int]]]:
        """All terms in byte order with their counters."""
        at = self.root_holder[0] if at is None else at
        if type(at) is dict:
            for rest in sorted(at):
                yield prefix + rest, at[rest]
            return
        yield from ((prefix, c) for c in at[256].values())
        for b in range(256):
            if at[b]:
                yield from self.items(prefix + bytes((b,)), at[b])


def pack(items: list[tuple[bytes, list[int]]]) -> bytes:
    """Sorted terms with counters as one blob: shared-prefix lengths, suffixes, counters."""
    shared, lengths, tails, last = [], [], [], b""
    for term, _ in items:
        n, most = 0, min(len(term), len(last), 255)
        while n < most and term[n] == last[n]:
            n += 1
        shared.append(n)
        lengths.append(len(term) - n)
        tails.append(term[n:])
        last = term
    head = np.array([len(items)], dtype="<i8").tobytes()
    counts = np.array([c for _, c in items], dtype="<i8").reshape(-1, 2)
    return head + np.array(shared, dtype="u1").tobytes() + np.array(lengths, dtype="<i4").tobytes() + counts.tobytes() + b"".join(tails)


def unpack(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """The inverse of :func:`pack`."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    shared = np.frombuffer(blob, "u1", n, 8).tolist()
    lengths = np.frombuffer(blob, "<i4", n, 8 + n).tolist()
    counts = np.frombuffer(blob, "<i8", 2 * n, 8 + 5 * n).reshape(-1, 2).tolist()
    at, last = 8 + 21 * n, b""
    for s, m, (occurrences, records) in zip(shared, lengths, counts):
        last = last[:s] + blob[at : at + m]
        at += m
        yield last, occurrences, records


def route(term: bytes, longer: dict[bytes, int]) -> bytes:
    """The term's routing prefix: ``longer`` says of a prefix that is too heavy how long the next one is; the whole term if it is shorter."""
    n = 1
    while len(term) > n and (more := longer.get(term[:n])):
        n = more
    return term[:n]


def _counter(longer: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()

        def send() -> Iterator[pa.RecordBatch]:
            prefixes, blobs, group, current = [], [], [], None
            for term, counts in trie.items():
                r = route(term, longer)
                if r != current:
                    if group:
                        prefixes.append(current)
                        blobs.append(pack(group))
                    group, current = [], r
                group.append((term, counts))
            if group:
                prefixes.append(current)
                blobs.append(pack(group))
            for i in range(0, len(blobs), 256):
                yield pa.RecordBatch.from_arrays([pa.array(prefixes[i : i + 256], pa.binary()), pa.array(blobs[i : i + 256], pa.binary())], names=["prefix", "subtree"])

        for b in batches:
            if not b.num_rows:
                continue
            d = pc.dictionary_encode(b.column(0))
            ids = d.indices.to_numpy()
            occurrences = np.bincount(ids, weights=b.column(1).to_numpy()).astype(np.int64).tolist()
            records = np.bincount(ids).tolist()
            for term, o, r in zip(d.dictionary.cast(pa.binary()).to_pylist(), occurrences, records):
                trie.add(term, o, r)
            if trie.size >= TASK_TERMS:
                yield from send()
                trie = BurstTrie()
        yield from send()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges subtrees of the same prefix; a task sees its prefixes one after another."""
    current, trie = None, BurstTrie()

    def rows() -> Iterator[pa.RecordBatch]:
        terms, occurrences, records = [], [], []
        for term, (o, r) in trie.items():
            terms.append(term)
            occurrences.append(o)
            records.append(r)
            if len(terms) == 20_000:
                yield _result(terms, occurrences, records)
                terms, occurrences, records = [], [], []
        if terms:
            yield _result(terms, occurrences, records)

    for b in batches:
        for prefix, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if prefix != current:
                yield from rows()
                current, trie = prefix, BurstTrie()
            for term, o, r in unpack(blob):
                trie.add(term, o, r)
    yield from rows()


def _result(terms: list, occurrences: list, records: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], names=["item", "occurrences", "records"])


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def routing_prefixes(terms: DataFrame, weight: int | None = None) -> dict[bytes, int]:
    """Prefixes of more than ``weight`` distinct terms of the column ``term`` -> length of the next prefix.

    The distinct terms are written to the shared folder once; each round then counts the terms of the prefixes
    that were too heavy in the round before. The smallest and the largest term of a prefix tell
    what all its terms share, so a round always splits, and there are few rounds. Each round brings at most
    MAX_ROUTES prefixes to the driver.
    """
    spark, path = terms.sparkSession, shared_dir(terms.sparkSession, "vocabulary")
    terms.select(F.encode("term", "UTF-8").alias("t")).where(F.length("t") > 0).distinct().write.parquet(path)
    level = spark.read.schema("t binary").parquet(path)
    weight = max(weight or ROUTE_WEIGHT, level.count() // MAX_ROUTES)
    level, longer = level.withColumn("n", F.lit(1)), {}
    while True:
        cut = level.where(F.length("t") > F.col("n")).withColumn("p", F.substring("t", F.lit(1), F.col("n")))
        heavy = cut.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("a"), F.max("t").alias("b")).where(F.col("k") > weight).collect()
        if not heavy:
            return longer
        fresh = {bytes(r.p): max(_shared(bytes(r.a), bytes(r.b)), len(r.p)) + 2 for r in heavy}
        longer |= fresh
        level = cut.drop("n").join(F.broadcast(spark.createDataFrame(list(fresh.items()), "p binary, n int")), "p").select("t", "n")


def count_terms(df: DataFrame, term: str, record: str, place: str | None = None, weight: int | None = None) -> DataFrame:
    """``item, occurrences, records`` of every distinct term.

    ``occurrences``: distinct ``place`` values within records, so that repeated rows count
    once (without ``place``: one per record); ``records``: distinct records. Rows without term
    or record are left out; an empty string is a term; a null place is a place. No rows for
    an empty table. Columns besides those named are ignored.
    """
    rows = df.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    cols = [F.col(record).alias("record"), F.col(term).alias("term")] + ([F.col(place).alias("place")] if place else [])
    # One exchange, by (record, term): each pair's repeats meet, and a hot term spreads over its records.
    rows = rows.select(*cols).repartition("record", "term")
    if place:
        rows = rows.distinct()
    pairs = rows.groupBy("record", "term").agg(F.count(F.lit(1)).alias("n") if place else F.lit(1).cast("bigint").alias("n")).select("term", "n")
    longer = routing_prefixes(df.where(F.col(term).isNotNull() & F.col(record).isNotNull()).select(F.col(term).alias("term")), weight)
    tries = pairs.mapInArrow(_counter(longer), "prefix binary, subtree binary")
    merged = tries.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_merge, "item binary, occurrences bigint, records bigint")
    return merged.withColumn("item", F.col("item").cast("string"))


def mark_items(counts: DataFrame, total, rare: int, common: float) -> DataFrame:
    """``counts`` with ``mark``: 'rare' at most ``rare`` records, 'common' more than ``common`` of ``total``, else null.

    In a collection so small that both hold, an item counts as rare.
    """
    from fractions import Fraction

    share = Fraction(str(common))
    often = F.col("records") * F.lit(share.denominator) > total * F.lit(share.numerator)
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(often, "common"))

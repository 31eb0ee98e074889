"""Mixing sources to target weights (min-cost flow for overlapping sources).

Documents are aggregated to a few patterns: the set of sources a document may count for.
Token capacity flows from patterns to source quotas; each further repetition of a pattern's
tokens costs more than the one before (convex costs), so the flow repeats as little as it
can and uses a pattern shared by sources where it is needed most. Only the patterns come to the
driver. Documents are then selected by a seeded hash until the flow's tokens are used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydex.session import ensure_checkpoint_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Patterns that may come to the driver; more are refused, never dropped.
MAX_PATTERNS = 100_000
#: Documents of a slice of a pattern's seeded order, for the running token count.
SLICE_ROWS = 50_000

_encoders: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer, loaded once in each worker."""
    if path not in _encoders:
        import importlib.util
        import os

        import tiktoken

        spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(os.path.dirname(path), "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``tokens BIGINT`` in place of its text: 0 for a null or empty text; whole texts are tokenized."""
    rest = [c for c in df.columns if c not in (text, "tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*rest, "tokens"])

    picked = df.select(text, *rest)
    from pyspark.sql.types import LongType, StructType

    return picked.mapInArrow(run, StructType(picked.schema.fields[1:]).add("tokens", LongType()))


def source_name(c: Column) -> Column:
    """Without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


@dataclass(frozen=True)
class Target:
    """A source's wanted share of all tokens and how often a document may be used."""

    source: str
    share: Fraction
    max_repeats: int


@dataclass
class Plan:
    """What the flow found: tokens of each (pattern, source), of each source's quota what is short, the quotas' total."""

    routed: dict[tuple[tuple[str, ...], str], Fraction]
    short: dict[str, Fraction]
    total: int
    repeats: dict[str, int]


def read_targets(df: DataFrame) -> list[Target]:
    """The rows of ``source, target_share, max_repeats``; of repeated sources the first in order of share and repeats. Rows without source or share are left out."""
    rows = df.select("source", F.col("target_share").cast("double"), "max_repeats").where("source IS NOT NULL AND target_share IS NOT NULL").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sources")
    best: dict[str, Target] = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[1], -(r[2] or 0))):
        best.setdefault(r[0], Target(r[0], Fraction(str(r[1])), max(r[2] or 0, 0)))
    return list(best.values())


class _Flow:
    """A network with integer capacities and maximum flows by blocking flows; flows stay when capacities are raised."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.capacity: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.capacity += [capacity, 0]
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def reaching(self, t: int) -> list[bool]:
        """Nodes from which more could flow to ``t``."""
        seen, queue = [False] * len(self.out), [t]
        seen[t] = True
        for b in queue:
            for e in self.out[b]:
                a = self.to[e]
                if not seen[a] and self.capacity[e ^ 1]:
                    seen[a] = True
                    queue.append(a)
        return seen

    def push(self, s: int, t: int) -> int:
        """Makes the flow from ``s`` to ``t`` maximal; returns what was added."""
        to, capacity, out, added = self.to, self.capacity, self.out, 0
        while True:
            depth = [-1] * len(out)
            depth[s], queue = 0, [s]
            for a in queue:
                for e in out[a]:
                    if capacity[e] and depth[to[e]] < 0:
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if depth[t] < 0:
                return added
            at, path, a = [0] * len(out), [], s
            while True:
                if a == t:
                    n = min(capacity[e] for e in path)
                    added += n
                    for e in path:
                        capacity[e] -= n
                        capacity[e ^ 1] += n
                    full = next(i for i, e in enumerate(path) if not capacity[e])
                    a = to[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = out[a]
                while at[a] < len(edges) and not (capacity[edges[at[a]]] and depth[to[edges[at[a]]]] == depth[a] + 1):
                    at[a] += 1
                if at[a] < len(edges):
                    path.append(edges[at[a]])
                    a = to[edges[at[a]]]
                elif path:
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def _cheapest(flow: _Flow, sources: list[tuple[int, int, int]], s: int, t: int) -> None:
    """A maximum flow whose cost is least when the k-th use of a source edge costs k.

    ``sources`` are ``(edge, amount of one use, most uses)``. Only source edges cost anything and costs
    rise, so the flow is found use by use: all k-th uses before any k+1-th. Uses that all edges
    still open can take in full are granted many at once. An edge from which nothing more can reach ``t``
    after a round never can again, so the rounds end after as many as there are bottlenecks.
    """
    used = [0] * len(sources)
    while True:
        open_ = flow.reaching(t)
        live = [i for i, (e, n, most) in enumerate(sources) if used[i] < most and open_[flow.to[e]]]
        if not live:
            return
        whole = sum(sources[i][1] for i in live)
        before = list(flow.capacity)

        def grant(uses: int) -> bool:
            """Whether everything flows if each open edge is used so often more."""
            flow.capacity[:] = before
            for i in live:
                flow.capacity[sources[i][0]] += uses * sources[i][1]
            return flow.push(s, t) == uses * whole

        low, high = 0, min(sources[i][2] - used[i] for i in live)
        best = None
        while low < high:  # the most uses that flow in full
            n = (low + high + 1) // 2 if best or low else high
            if grant(n):
                low, best = n, list(flow.capacity)
            else:
                high = n - 1
        if low:
            flow.capacity[:] = best
        else:
            grant(1)
        for i in live:
            used[i] += max(low, 1)


def plan_mixture(patterns: dict[tuple[str, ...], int], targets: list[Target], total: int) -> Plan:
    """Routes tokens of ``patterns`` (sources -> tokens) to the quotas ``share x total``.

    A pattern's tokens can be used once for each repetition its most generous source
    allows; a source takes them at most as often as it allows itself. The k-th
    use costs k, for every k. Exact: all amounts are scaled to integers.
    """
    wanted = {t.source: t for t in targets}
    scale = 1
    for t in targets:
        scale = scale * t.share.denominator // _gcd(scale, t.share.denominator)
    live = [(p, n) for p, n in sorted(patterns.items()) if n > 0 and any(s in wanted for s in p)]
    source_at = {t.source: 2 + len(live) + i for i, t in enumerate(targets)}
    flow = _Flow(2 + len(live) + len(targets))
    routes, sources = {}, []
    for i, (pattern, n) in enumerate(live):
        mine = [s for s in pattern if s in wanted]
        sources.append((flow.edge(0, 2 + i, 0), n * scale, max(wanted[s].max_repeats for s in mine)))
        for s in mine:
            capacity = n * scale * wanted[s].max_repeats
            routes[pattern, s] = flow.edge(2 + i, source_at[s], capacity), capacity
    quotas = {t.source: flow.edge(source_at[t.source], 1, int(t.share * scale * total)) for t in targets}
    _cheapest(flow, sources, 0, 1)
    routed = {k: Fraction(capacity - flow.capacity[e], scale) for k, (e, capacity) in routes.items()}
    short = {s: Fraction(flow.capacity[e], scale) for s, e in quotas.items()}
    return Plan(routed, short, total, {t.source: t.max_repeats for t in targets})


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def pattern_sizes(sized: DataFrame, pattern: str = "pattern") -> dict[tuple[str, ...], int]:
    """Tokens by pattern (an array of sources); map-side combined, at most MAX_PATTERNS rows come to the driver."""
    rows = sized.groupBy(pattern).agg(F.sum("tokens").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return {tuple(r[0]): int(r[1]) for r in rows}


def sized_documents(documents: DataFrame, targets: list[Target], path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, pattern, tokens`` of the documents of wanted sources; a document's pattern is its own source."""
    named = documents.select("text", "doc_id", source_name(F.col("source")).alias("source"))
    mine = named.where(F.col("source").isin([t.source for t in targets]))
    return token_counts(mine, path=path).withColumn("pattern", F.array("source"))


def kept(sized: DataFrame) -> DataFrame:
    """``sized`` written to the shared folder, so that counting and selecting tokenize each text once."""
    ensure_checkpoint_dir(sized.sparkSession)
    return sized.checkpoint()


def overlapping_documents(documents: DataFrame, targets: list[Target], path: str = TOKENIZER) -> DataFrame:
    """As :func:`sized_documents`, but one row per distinct text, whose pattern is all wanted sources that hold a copy.

    ``doc_id`` is the smallest of the copies. Texts meet by a 128-bit digest, so that no text is shuffled.
    """
    named = documents.select("text", "doc_id", source_name(F.col("source")).alias("source"))
    mine = named.where(F.col("source").isin([t.source for t in targets]) & (F.length("text") > 0))
    keyed = token_counts(mine.withColumn("digest", F.md5(F.col("text").cast("binary"))), path=path)
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"))


def unreachable(plan: Plan) -> list[str]:
    """Sources whose quota the flow couldn't fill."""
    return sorted(s for s, x in plan.short.items() if x > 0)


def select_documents(sized: DataFrame, plan: Plan, seed: int = 0) -> DataFrame:
    """``doc_id, source, pattern, tokens, uses``: how often each document is used for each source.

    All documents of a pattern are used floor(routed / tokens) times; for the rest, documents
    are used once more in seeded order while their running tokens stay within it. The running count goes over
    slices of the seeded order first, so that no task sorts a whole source. A pattern's
    sources take disjoint stretches of that order, one after another.
    """
    spark: SparkSession = sized.sparkSession
    sizes = {}
    for (pattern, s), n in plan.routed.items():
        sizes.setdefault(pattern, []).append((s, n))
    total = sized.groupBy("pattern").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("documents"))
    rows, at = [], {}
    for pattern, parts in sizes.items():
        begin = Fraction(0)
        for s, n in sorted(parts):
            rows.append((list(pattern), s, float(begin), float(begin + n)))
            begin += n
        at[pattern] = begin
    quota = spark.createDataFrame(rows, "pattern array<string>, source string, begin double, upto double")
    h = F.xxhash64("doc_id", F.lit(seed))
    slices_of = F.ceil(F.col("documents") / SLICE_ROWS)  # as many as the pattern's documents need
    docs = sized.drop("source").join(F.broadcast(total), "pattern").withColumn("h", h).withColumn("slice", F.pmod("h", slices_of)).drop("documents")
    slices = docs.groupBy("pattern", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    before = slices.withColumn("before", F.sum("slice_tokens").over(Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slice_tokens"))
    inside = Window.partitionBy("pattern", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        docs.withColumn("end_", F.sum("tokens").over(inside)).join(before.drop("slice_tokens"), ["pattern", "slice"])
        .withColumn("high", F.col("before") + F.col("end_"))
    )
    # Laps over the documents: a document's end on the k-th lap is high + k x size; it is used for the source whose stretch holds it.
    laps = lambda x: F.greatest(F.lit(0), F.floor((x - F.col("high")) / F.col("size")) + 1)
    joined = placed.join(F.broadcast(quota), "pattern").withColumn("uses", (laps(F.col("upto")) - laps(F.col("begin"))).cast("bigint"))
    return joined.where(F.col("uses") > 0).select("doc_id", "source", "pattern", "tokens", "uses")


def report_shares(used: DataFrame, targets: list[Target]) -> DataFrame:
    """``source, target_share, tokens_used, documents_used, share_reached`` for every target, also one that got nothing."""
    spark = used.sparkSession
    wanted = spark.createDataFrame([(t.source, float(t.share)) for t in targets], "source string, target_share double")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.count_distinct("doc_id").alias("documents_used"))
    rows = wanted.join(got, "source", "left").na.fill(0, ["tokens_used", "documents_used"])
    everything = F.sum("tokens_used").over(Window.partitionBy())  # over the few sources
    return rows.withColumn("share_reached", F.try_divide("tokens_used", everything))

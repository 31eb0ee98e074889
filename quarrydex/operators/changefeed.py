"""Current state of a table from a feed of puts, partial updates and deletes.

Ordered replay: changes are sorted by key and sequence within partitions and folded by a
small state machine. The fold is associative, so it runs twice: first over every input
partition as it is (no shuffle; a hot key shrinks to one state per partition), then, after
a repartition by key, over these states. No task ever holds all changes of a hot key.

A state row is ``key.., seq, deleted_seq`` and per column ``c`` a pair ``c, c__seq``: the
newest sequence seen, the newest delete, and each column's newest value with its sequence.
A change is a state row itself, which is why changes, states of earlier runs and states of
other partitions all go through the same fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, DEL = "__seq", "__deleted_seq"
NEVER = -(2**63)


def _set(c: str) -> str:
    return f"__set_{c}"


def _as_states(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], deleted: Column, is_set: dict[str, Column]) -> DataFrame:
    """Every change as a state row; rows without a key or sequence are no changes."""
    ok = F.col(seq).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    gone = F.coalesce(deleted, F.lit(False))
    s = F.col(seq).cast("bigint")
    never = F.lit(NEVER).cast("bigint")
    out = [F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)] + [s.alias(SEQ), F.when(gone, s).otherwise(never).alias(DEL)]
    for c in columns:
        on = ~gone & F.coalesce(is_set.get(c, F.col(c).isNotNull()), F.lit(False))
        out += [F.when(on, F.col(c)).alias(c), F.when(on, s).otherwise(never).alias(_set(c))]
    return df.where(ok).select(*out)


def _starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where a new key begins in a batch sorted by key."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for i in range(n_keys):
        k = batch.column(i)
        new[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _largest(values: pa.Array, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of ``rows``, which have the same sequence within a group, the one with the largest value in each group."""
    picked = values.take(pa.array(rows))
    try:
        rank = pc.rank(picked, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    except pa.ArrowNotImplementedError:  # nested values: by their text
        text = pa.array([None if x is None else repr(x) for x in picked.to_pylist()])
        rank = pc.rank(text, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((rank, group))
    last = np.flatnonzero(np.append(group[order][1:] != group[order][:-1], True))
    return rows[order[last]]


def fold_states(batch: pa.RecordBatch, n_keys: int, columns: Sequence[str]) -> pa.RecordBatch:
    """One state row per key of ``batch``, whose rows are sorted by key, then sequence.

    A row whose sequence was applied already changes nothing. If rows of one key share a
    sequence but not their content, a delete wins against a value, and the largest of several
    values wins, nulls being smallest.
    """
    starts = _starts(batch, n_keys)
    ends = np.append(starts[1:], batch.num_rows) - 1
    group = np.repeat(np.arange(len(starts)), ends - starts + 1)
    rows = np.arange(batch.num_rows)
    names = batch.schema.names
    out = {names[i]: batch.column(i).take(pa.array(starts)) for i in range(n_keys)}
    for name in (SEQ, DEL):
        out[name] = pa.array(np.maximum.reduceat(batch.column(name).to_numpy(), starts))
    for c in columns:
        seqs = batch.column(_set(c)).to_numpy()
        top = np.maximum.reduceat(seqs, starts)
        newest = rows[seqs == top[group]]
        if len(newest) > len(starts):
            newest = _largest(batch.column(c), newest, group[newest])
        out[c] = batch.column(c).take(pa.array(newest))
        out[_set(c)] = pa.array(top)
    return pa.RecordBatch.from_arrays([out[n] for n in names], schema=batch.schema)


def folder(n_keys: int, columns: Sequence[str]):
    """A ``mapInArrow`` function over batches sorted by key: keeps the last key's state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            if carry is not None:
                t = pa.Table.from_batches([carry, b.cast(carry.schema)]).combine_chunks()
                b = t.to_batches()[0]
            states = fold_states(b, n_keys, columns)
            carry = states.slice(states.num_rows - 1)
            if states.num_rows > 1:
                yield states.slice(0, states.num_rows - 1)
        if carry is not None:
            yield carry

    return run


def replay_changes(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    columns: Sequence[str],
    deleted: Column,
    is_set: dict[str, Column] | None = None,
    applied: DataFrame | None = None,
) -> DataFrame:
    """State rows after applying all changes of ``df``.

    ``deleted`` marks deletes; any other change sets those ``columns`` for which
    ``is_set[c]`` holds (default: those not null) and leaves the rest as they were, unless
    a delete came between: it clears all columns. ``applied`` is the result of an earlier
    run; its states take part, and changes already contained in them change nothing, so
    repeated and overlapping deliveries are safe. Rows without key or sequence are no
    changes; keys are compared byte by byte; an empty value is a value. Other columns of
    ``df`` are ignored, whatever their names. The result has ``keys``, ``seq`` (newest
    change), ``deleted_seq`` and ``columns`` with ``<column>_seq`` (nulls for "never").
    An empty feed gives no rows.
    """
    clash = set(keys) & set(columns)
    if clash:
        raise ValueError(f"columns are keys too: {sorted(clash)}")
    n = len(keys)
    states = _as_states(df, keys, seq, columns, deleted, is_set or {})
    if applied is not None:
        never = F.lit(NEVER).cast("bigint")
        back = [F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)] + [F.col("seq").alias(SEQ), F.coalesce("deleted_seq", never).alias(DEL)]
        for c in columns:
            back += [F.col(c), F.coalesce(F.col(f"{c}_seq"), never).alias(_set(c))]
        states = states.unionByName(applied.select(*back))
    key_names = [f"__key_{i}" for i in range(n)]
    order = [*key_names, SEQ, *columns]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in states.schema.fields])
    fold = folder(n, columns)
    once = states.sortWithinPartitions(*order).mapInArrow(fold, schema)
    final = once.repartition(*key_names).sortWithinPartitions(*order).mapInArrow(fold, schema)
    known = lambda c: F.when(F.col(c) != NEVER, F.col(c))
    # A delete clears what was set before it.
    alive = {c: F.col(_set(c)) > F.col(DEL) for c in columns}
    return final.select(
        *[F.col(f"__key_{i}").alias(k) for i, k in enumerate(keys)],
        F.col(SEQ).alias("seq"),
        known(DEL).alias("deleted_seq"),
        *[x for c in columns for x in (F.when(alive[c], F.col(c)).alias(c), F.when(alive[c], F.col(_set(c))).alias(f"{c}_seq"))],
    )


def live_rows(states: DataFrame) -> DataFrame:
    """States whose newest change is not a delete."""
    return states.where(F.col("deleted_seq").isNull() | (F.col("deleted_seq") < F.col("seq")))

"""Queries on hot keys and on the change feed of ``kv_log``, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.operators.changefeed import live_rows, replay_changes
from quarrydex.operators.profile import compress_values, heavy_keys, profile_keys, weighted_percentiles
from quarrydex.session import shared_dir
from quarrydex.sources.tables import table

HEAVY_SHARE = 0.02
FIRST_RUN = dt.datetime(2025, 3, 16)


def _kv_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compress_values(table(spark, d, "kv_log"), F.col("key"), F.col("value"))


def _token_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compress_values(table(spark, d, "tokens"), F.col("term"), F.col("pos"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys and terms that hold at least 2 % of their table's rows."""
    kv = heavy_keys(table(spark, d, "kv_log"), F.col("key"), F.col("value"), HEAVY_SHARE).select(F.lit("kv_log").alias("src"), "key")
    terms = heavy_keys(table(spark, d, "tokens"), F.col("term"), F.col("pos"), HEAVY_SHARE).select(F.lit("tokens").alias("src"), "key")
    return kv.unionAll(terms)


def p1_key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per key of ``kv_log``: rows, tombstones, distinct values, most frequent value."""
    return profile_keys(_kv_pairs(spark, d)).select("key", "n_rows", "n_null", "n_values", F.hex("mode").alias("mode_hex"), "mode_weight")


def p1_term_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per term of ``tokens``: rows, distinct positions, most frequent, first and last position."""
    return profile_keys(_token_pairs(spark, d))[["key", "n_rows", "n_values", "mode", "mode_weight", "min_value", "max_value"]]


def p1_term_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles and 90th percentile of the positions of every term."""
    return weighted_percentiles(_token_pairs(spark, d), [0.25, 0.5, 0.75, 0.9])


def _kv_state(spark: SparkSession, d: str) -> DataFrame:
    return replay_changes(table(spark, d, "kv_log"), ["key"], "seq", ["value"], F.col("value").isNull())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys with the sequence of their newest change."""
    return live_rows(_kv_state(spark, d)).select("key", "seq")


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """The store's state: every key that was ever changed, with value, newest change and newest tombstone."""
    return _kv_state(spark, d).select("key", "seq", "deleted_seq", F.hex("value").alias("value_hex"))


def p2_partial_updates(spark: SparkSession, d: str) -> DataFrame:
    """Partial-column replay: changes of ``kv_log`` set ``segment`` always and ``value`` only if it isn't empty; tombstones delete."""
    log = table(spark, d, "kv_log").select("key", "seq", "value", F.col("segment_id").alias("segment"))
    setting = {"value": F.length("value") > 0}
    states = replay_changes(log, ["key"], "seq", ["value", "segment"], F.col("value").isNull(), setting)
    return live_rows(states).select("key", "seq", F.hex("value").alias("value_hex"), "value_seq", "segment")


def p2_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same state in two runs: what had arrived by a day first, then the whole feed, those changes again, on top of the states of the first run."""
    log = table(spark, d, "kv_log")
    args = (["key"], "seq", ["value"], F.col("value").isNull())
    path = shared_dir(spark, "states")
    replay_changes(log.where(F.col("arrived_at") < F.lit(FIRST_RUN)), *args).write.parquet(path)
    states = replay_changes(log, *args, applied=spark.read.parquet(path))
    return states.select("key", "seq", "deleted_seq", F.hex("value").alias("value_hex"))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_profile, p1_term_profile, p1_term_percentiles, p2_found, p2_state, p2_resumed, p2_partial_updates)}

_HEAVY = """
SELECT '{t}' AS src, {k} AS key FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}
HAVING count(*) * 50 >= (SELECT count(*) FROM {t} WHERE {k} IS NOT NULL)"""

_STATE = """
WITH c AS (SELECT DISTINCT key, seq, value FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL),
s AS (SELECT key, max(seq) AS seq, max(CASE WHEN value IS NULL THEN seq END) AS deleted_seq FROM c GROUP BY key)
SELECT s.key, s.seq, deleted_seq, hex(value) AS value_hex FROM s JOIN c ON s.key = c.key AND s.seq = c.seq"""

ORACLE = {
    "p1_found": _HEAVY.format(t="kv_log", k="key") + " UNION ALL " + _HEAVY.format(t="tokens", k="term"),
    "p1_key_profile": """
WITH w AS (SELECT key, value, count(*) AS n FROM kv_log WHERE key IS NOT NULL GROUP BY ALL),
r AS (SELECT key, hex(value) AS mode_hex, n AS mode_weight, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS i FROM w WHERE value IS NOT NULL),
k AS (SELECT key, count(*) AS n_rows, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_values FROM kv_log WHERE key IS NOT NULL GROUP BY key)
SELECT k.*, mode_hex, mode_weight FROM k LEFT JOIN r ON k.key = r.key AND i = 1""",
    "p1_term_profile": """
WITH r AS (SELECT term, pos, count(*) AS n, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, pos) AS i FROM tokens WHERE term IS NOT NULL AND pos IS NOT NULL GROUP BY term, pos),
k AS (SELECT term, count(*) AS n_rows, count(DISTINCT pos) AS n_values, min(pos) AS min_value, max(pos) AS max_value FROM tokens WHERE term IS NOT NULL GROUP BY term)
SELECT k.term AS key, n_rows, n_values, pos AS mode, n AS mode_weight, min_value, max_value FROM k LEFT JOIN r ON k.term = r.term AND i = 1""",
    "p1_term_percentiles": """
SELECT term AS key, fraction, percentile FROM (
  SELECT term, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS fraction, unnest(quantile_disc(pos, [0.25, 0.5, 0.75, 0.9])) AS percentile
  FROM tokens WHERE term IS NOT NULL AND pos IS NOT NULL GROUP BY term)""",
    "p2_found": """
SELECT key, max(seq) AS seq FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL GROUP BY key
HAVING arg_max(value IS NOT NULL, seq)""",
    "p2_state": _STATE,
    "p2_resumed": _STATE,
    "p2_partial_updates": """
WITH c AS (SELECT key, seq, value, segment_id AS segment FROM kv_log WHERE key IS NOT NULL AND seq IS NOT NULL),
s AS (SELECT key, max(seq) AS seq, coalesce(max(CASE WHEN value IS NULL THEN seq END), -1) AS gone FROM c GROUP BY key),
v AS (SELECT c.key, max(c.seq) AS value_seq, hex(arg_max(value, c.seq)) AS value_hex FROM c JOIN s ON c.key = s.key AND c.seq > gone WHERE octet_length(value) > 0 GROUP BY c.key),
g AS (SELECT c.key, max(segment) AS segment FROM c JOIN s ON c.key = s.key AND c.seq = s.seq GROUP BY c.key)
SELECT s.key, s.seq, value_hex, value_seq, segment FROM s JOIN g USING (key) LEFT JOIN v USING (key) WHERE gone < s.seq""",
}

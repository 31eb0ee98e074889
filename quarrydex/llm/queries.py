"""Queries on records, terms and texts for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.llm import contamination, distinctive, mixture, pii, seen_keys, term_frequency
from quarrydex.session import shared_dir
from quarrydex.sources.tables import table
from quarrydex.streaming.files import stream_table

RARE, COMMON_TERM, COMMON_GRAM = 2, 0.2, 0.02


def _marked_probes(spark: SparkSession, d: str, files: str | None = None, max_files: int | None = None) -> DataFrame:
    """Marks the probes of ``d``; the stream reads the tables in ``files`` (else those of ``d``), ``max_files`` a micro-batch."""
    own = seen_keys.state_session(spark)
    history = stream_table(own, files or d, "kv_log", "key string", max_files)
    probes = stream_table(own, files or d, "key_probes", "probe_id bigint, key string", max_files).select("key", seen_keys.order_of("probe_id").alias("probe_order"))
    firsts = seen_keys.run_stream(spark, history, probes)
    return seen_keys.mark_probes(table(spark, d, "key_probes"), firsts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Probes whose key is in the store's history or in an earlier probe."""
    return _marked_probes(spark, d).where("seen").select("probe_id")


def p3_many_batches(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`p3_found`, both tables cut into files that arrive one by one, out of order, history not before probes."""
    base = shared_dir(spark, "arrivals")
    for name, columns in (("kv_log", ["key"]), ("key_probes", ["probe_id", "key"])):
        table(spark, d, name).select(*columns).repartition(4, *columns).write.parquet(f"{base}/{name}.parquet")
    return _marked_probes(spark, d, base, 1).where("seen").select("probe_id")


def p3_wrong_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of wrong answers of :func:`p3_found`, against two batch joins."""
    truth = seen_keys.exact_answers(table(spark, d, "kv_log").select("key"), table(spark, d, "key_probes"))
    return seen_keys.wrong_answers(_marked_probes(spark, d), truth)


def p3_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per segment: how often its stored Bloom filter answers wrongly."""
    own = table(spark, d, "kv_log").select("segment_id", "key")
    return seen_keys.audit_filters(table(spark, d, "segment_blooms"), own, table(spark, d, "key_probes").select("key"))


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "tokens")
    total = tokens.where("term IS NOT NULL").agg(F.count_distinct("doc_id")).scalar()
    return term_frequency.mark_items(term_frequency.count_terms(tokens, "term", "doc_id", "pos"), total, RARE, COMMON_TERM)


def _gram_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "kgrams")
    total = grams.agg(F.count_distinct("term")).scalar()
    return term_frequency.mark_items(term_frequency.count_terms(grams, "gram", "term"), total, RARE, COMMON_GRAM)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms and grams too rare or too common to help a search."""
    both = _term_counts(spark, d).select(F.lit("term").alias("field"), "item", "mark").unionAll(_gram_counts(spark, d).select(F.lit("gram").alias("field"), "item", "mark"))
    return both.where("mark IS NOT NULL")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term."""
    return _term_counts(spark, d)


def p4_grams(spark: SparkSession, d: str) -> DataFrame:
    """Terms that hold each gram."""
    return _gram_counts(spark, d).select("item", "records", "mark")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.score_terms(table(spark, d, "tokens"), "doc_id", "term", "pos").withColumnRenamed("record", "doc_id")


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """Divergence score of every record and term that at least two records hold."""
    return _scored(spark, d).select("doc_id", "term", "tf", "records", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand out: 2 x occurrences in the record >= 3 x records with the term."""
    return distinctive.standing_out(table(spark, d, "tokens"), "doc_id", "term", "pos").withColumnRenamed("record", "doc_id")


def p5_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The three most distinctive terms of each record."""
    scored = _scored(spark, d).select(F.col("doc_id").alias("record"), "term", F.round("score", 6).alias("score"))
    return distinctive.top_terms(scored, 3).withColumnRenamed("record", "doc_id")


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share 12 words in a row with a test item."""
    return contamination.exact_leaks(*_texts(spark, d))


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a test item's template, its numbers and names perhaps replaced."""
    return contamination.template_leaks(*_texts(spark, d))


def p6_template_members(spark: SparkSession, d: str) -> DataFrame:
    """Which test items share a template window with each representative of :func:`p6_templates`."""
    return contamination.template_members(_texts(spark, d)[1])


def _mixture(spark: SparkSession, d: str, keep: bool = True) -> tuple[DataFrame, list[mixture.Target], mixture.Plan]:
    targets = mixture.read_targets(table(spark, d, "mix_targets"))
    sized = mixture.sized_documents(table(spark, d, "documents"), targets)
    sized = mixture.kept(sized) if keep else sized
    patterns = mixture.pattern_sizes(sized)
    return sized, targets, mixture.plan_mixture(patterns, targets, sum(patterns.values()))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share."""
    return spark.createDataFrame([(s,) for s in mixture.unreachable(_mixture(spark, d, keep=False)[2])], "source string")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    sized, _, plan = _mixture(spark, d)
    return mixture.select_documents(sized, plan).select("doc_id", "source", "tokens", "uses")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source: wanted share, tokens used and the share reached."""
    sized, targets, plan = _mixture(spark, d)
    used = mixture.select_documents(sized, plan)
    return mixture.report_shares(used, targets)


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Per source: whether it falls short, and whether its tokens come within one document of what it is due."""
    sized, targets, plan = _mixture(spark, d)
    used = mixture.select_documents(sized, plan)
    due = spark.createDataFrame([(t.source, float(sum((n for (_, s), n in plan.routed.items() if s == t.source), 0)), plan.short[t.source] > 0) for t in targets], "source string, due double, short boolean")
    largest = sized.groupBy("source").agg(F.max("tokens").alias("largest"))
    got = mixture.report_shares(used, targets).select("source", "target_share", "tokens_used")
    return got.join(due, "source").join(largest, "source", "left").select(
        "source", "target_share", "short", (F.abs(F.col("tokens_used") - F.col("due")) <= F.coalesce("largest", F.lit(0))).alias("within"),
    )


def _overlap(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixture.Target]]:
    targets = mixture.read_targets(table(spark, d, "mix_targets"))
    sized = mixture.kept(mixture.overlapping_documents(table(spark, d, "documents"), targets))
    patterns = mixture.pattern_sizes(sized)
    return mixture.select_documents(sized, mixture.plan_mixture(patterns, targets, sum(patterns.values()))), targets


def p7_overlap_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each distinct text is used for which of the sources that hold a copy."""
    return _overlap(spark, d)[0].select("doc_id", "source", F.array_join("pattern", " ").alias("pattern"), "tokens", "uses")


def p7_overlap_shares(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`p7_shares`, each distinct text counting for any of the sources that hold a copy."""
    return mixture.report_shares(*_overlap(spark, d))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, pii.Model]:
    documents = table(spark, d, "documents")
    return documents, pii.fit_model(documents, table(spark, d, "name_lexicon"))


def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """The random field's marginals: every place that may be personal information, and how likely it is of which kind."""
    return pii.span_marginals(*_model(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information as it stands in the documents."""
    return pii.find_personal(*_model(spark, d))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with personal information replaced by placeholders."""
    return pii.redact_documents(*_model(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_many_batches, p3_wrong_rate, p3_filter_audit, p4_found, p4_terms, p4_grams, p5_method, p5_found, p5_top_terms,
        p6_found, p6_templates, p6_template_members, p7_found, p7_mixture, p7_shares, p7_quotas, p7_overlap_mixture, p7_overlap_shares, p8_method, p8_found, p8_redacted,
    )
}

_P3 = """
k AS (SELECT DISTINCT key FROM kv_log WHERE key IS NOT NULL),
f AS (SELECT key, min(probe_id) AS first FROM key_probes WHERE key IS NOT NULL GROUP BY key),
a AS (SELECT probe_id, k.key IS NOT NULL OR probe_id > first AS seen FROM key_probes p JOIN f ON p.key = f.key LEFT JOIN k ON p.key = k.key)"""

_TERMS = """
t AS (SELECT DISTINCT doc_id, pos, term FROM tokens WHERE term IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
c AS (SELECT term AS item, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM t GROUP BY term),
terms AS (SELECT item, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 > n THEN 'common' END AS mark FROM c, n)"""
_GRAMS = """
gn AS (SELECT count(DISTINCT term) AS n FROM kgrams),
gc AS (SELECT gram AS item, count(DISTINCT term) AS records FROM kgrams WHERE gram IS NOT NULL AND term IS NOT NULL GROUP BY gram),
grams AS (SELECT item, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 50 > n THEN 'common' END AS mark FROM gc, gn)"""

_P5 = """
t AS (SELECT DISTINCT doc_id, pos, term FROM tokens WHERE term IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
c AS (SELECT term, count(*) AS records, sum(tf) AS cf FROM p GROUP BY term),
l AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY doc_id),
n AS (SELECT sum(tf) AS n FROM p),
m AS (SELECT p.*, records, (tf + 100.0::DOUBLE * (cf / n)) / (length + 100.0::DOUBLE) AS pd, cf / n AS pc FROM p JOIN c USING (term) JOIN l USING (doc_id), n WHERE records >= 2),
s AS (SELECT doc_id, term, tf, records, round(pd * ln(pd / pc), 6) AS score FROM m)"""

# DuckDB has no compatibility forms; those of full width, common ligatures and the sharp s are folded by hand.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_FOLDED = """regexp_replace(regexp_replace(text, '\\p{Cf}', '', 'g'), '<[^<>]*>', '', 'g')"""
for _from, _to in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ß", "ss")):
    _FOLDED = f"replace({_FOLDED}, '{_from}', '{_to}')"
_P6 = f"""
s AS (SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM eval_items),
w AS (SELECT doc, id, regexp_extract_all(lower(translate({_FOLDED}, '{_WIDE[0]}', '{_WIDE[1]}')), '[\\p{{L}}\\p{{N}}]+') AS w FROM s WHERE id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc, id, list_slice(w, i, i + 11)::VARCHAR AS words FROM (SELECT doc, id, w, unnest(range(1, len(w) - 10)) AS i FROM w))"""

# Words and signs stand for tokens: any usual tokenizer gives the same list of sources.
_P7 = """
d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS n FROM documents),
z AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(n), 0) AS size FROM mix_targets m LEFT JOIN d ON d.source = m.source GROUP BY ALL),
q AS (SELECT source, target_share, size * max_repeats < target_share * (SELECT sum(size) FROM z) AS short FROM z)"""

ORACLE = {
    "p6_found": f"WITH {_P6} SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.words = i.words WHERE d.doc AND NOT i.doc",
    "p7_found": f"WITH {_P7} SELECT source FROM q WHERE short",
    "p7_quotas": f"WITH {_P7} SELECT source, target_share, short, true AS within FROM q",
    "p3_found": f"WITH {_P3} SELECT probe_id FROM a WHERE seen",
    "p3_many_batches": f"WITH {_P3} SELECT probe_id FROM a WHERE seen",
    "p3_wrong_rate": f"""WITH {_P3},
w AS (SELECT probe_id, row_number() OVER (PARTITION BY key ORDER BY old DESC, probe_id) > 1 AS seen FROM (
  SELECT probe_id, key, 0 AS old FROM key_probes WHERE key IS NOT NULL UNION ALL SELECT DISTINCT NULL, key, 1 FROM kv_log WHERE key IS NOT NULL) QUALIFY probe_id IS NOT NULL),
c AS (SELECT a.seen AS got, w.seen AS want FROM a JOIN w USING (probe_id))
SELECT count(*) AS probes, count(*) FILTER (got) AS repeats, count(*) FILTER (NOT got) AS firsts, count(*) FILTER (got AND NOT want) AS false_repeats,
count(*) FILTER (NOT got AND want) AS false_firsts, count(*) FILTER (got <> want)::DOUBLE / count(*) AS wrong_rate FROM c""",
    "p3_filter_audit": """
WITH f AS (SELECT * FROM segment_blooms WHERE segment_id IS NOT NULL),
asked AS (SELECT DISTINCT key FROM key_probes WHERE key IS NOT NULL),
own AS (SELECT DISTINCT segment_id, key FROM kv_log WHERE key IS NOT NULL AND segment_id IS NOT NULL),
h1 AS (SELECT key, list_reduce(list_transform(range(0, length(hex(key)) // 2), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::HUGEINT),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS a FROM (SELECT key FROM asked UNION SELECT key FROM own)),
h2 AS (SELECT key, a, xor(a >> 33, (a * 1791791791) % 18446744073709551616) AS b FROM h1),
h AS (SELECT key, a, CASE WHEN b = 0 THEN 1791791791 ELSE b END AS b FROM h2),
pairs AS (SELECT segment_id, key, true AS mine FROM own UNION ALL SELECT segment_id, key, false FROM f, asked WHERE (segment_id, key) NOT IN (SELECT segment_id, key FROM own)),
places AS (SELECT p.*, bits, a % m_bits AS i, b % m_bits AS j FROM pairs p JOIN f USING (segment_id) JOIN h USING (key)),
words AS (SELECT segment_id, mine, i, j, bits[(i // 64 + 1)::BIGINT]::HUGEINT AS wi, bits[(j // 64 + 1)::BIGINT]::HUGEINT AS wj FROM places),
answers AS (SELECT segment_id, mine, coalesce(((wi + 18446744073709551616) >> (i % 64)::INT) % 2 = 1, true) AND coalesce(((wj + 18446744073709551616) >> (j % 64)::INT) % 2 = 1, true) AS maybe FROM words)
SELECT segment_id, count(*) FILTER (mine) AS own_keys, count(*) FILTER (mine AND NOT maybe) AS false_no, count(*) FILTER (NOT mine) AS strangers, count(*) FILTER (NOT mine AND maybe) AS false_maybe
FROM answers GROUP BY segment_id""",
    "p4_found": f"WITH {_TERMS}, {_GRAMS} SELECT 'term' AS field, item, mark FROM terms WHERE mark IS NOT NULL UNION ALL SELECT 'gram', item, mark FROM grams WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {_TERMS} SELECT * FROM terms",
    "p4_grams": f"WITH {_GRAMS} SELECT * FROM grams",
    "p5_method": f"WITH {_P5} SELECT * FROM s",
    "p5_found": f"WITH {_P5} SELECT doc_id, term FROM p JOIN c USING (term) WHERE 2 * tf >= 3 * records",
    "p5_top_terms": f"WITH {_P5} SELECT * FROM (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 3",
}

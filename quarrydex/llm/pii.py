"""Personal information in free text (skip-chain conditional random field).

Nodes are the words that may be names and the spans shaped like mail addresses, numbers or street
addresses, each with a potential for every kind it may be (:mod:`.pii_nodes`). Neighbouring name words share a chain potential,
and equal or nearly equal nodes of a document, however far apart, a skip potential, in favour of
the same label. Loopy belief propagation (:mod:`.pii_field`) spreads what one mention's context says to all
the others; labels are the largest marginals.

All weights are learned together from silver labels (:mod:`.pii_fit`) on a bounded sample of documents
(``SAMPLE`` texts of at most ``MAX_TEXT`` characters, those with the smallest hashes of their ids). All else
covers every document and the whole of its text: also the counts that say which words are common, plain or
names that the lexicon lacks. The documents of an Arrow batch are one field.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.llm.pii_field import AT, KINDS, LABELS, Field
from quarrydex.llm.pii_fit import COUNTS, MAX_TEXT, SAMPLE, Corpus, at_least, count_words, learn, lexicon_sets, plain_words
from quarrydex.llm.pii_nodes import Model, add_text, names
from quarrydex.session import shared_dir

#: Lexicon words, and words of the corpus, that the model may hold.
MAX_LEXICON, MAX_WORDS = 200_000, 1_000_000
#: Characters of texts that make up one field.
FIELD_CHARS = 2_000_000
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

Found = tuple[int, int, str]


def find_in(texts: list[str], model: Model) -> list[list[Found]]:
    """For each text ``(start, end, kind)`` of everything found, in order, without overlaps."""
    crf = Field()
    read = [add_text(t, model, crf) for t in texts]
    best = crf.marginals().argmax(axis=1)
    out = []
    for r in read:
        found = [(s.start, s.end, LABELS[best[r.first + v]]) for v, s in enumerate(r.spans) if best[r.first + v]]
        at = r.first + len(r.spans)
        person = {i for v, i in enumerate(r.order) if best[at + v]}
        out.append(sorted(found + [(a, b, "person") for a, b in names(person, r.tokens)]))
    return out


def find_all(text: str, model: Model) -> list[Found]:
    """:func:`find_in` for one text."""
    return find_in([text], model)[0]


def marginals_in(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """For each text ``(start, end, kind, probability)`` of every node and each kind it may be."""
    crf = Field()
    read = [add_text(t, model, crf) for t in texts]
    p = crf.marginals()
    out = []
    for r in read:
        rows = [(s.start, s.end, x, float(p[r.first + v, AT[x]])) for v, s in enumerate(r.spans) for x in s.labels]
        at = r.first + len(r.spans)
        rows += [(r.tokens.toks[i][1], r.tokens.toks[i][2], "person", float(p[at + v, AT["person"]])) for v, i in enumerate(r.order)]
        out.append(sorted(rows))
    return out


def _in_fields(ids: list, texts: list, each) -> Iterator[tuple[list, list, list]]:
    """``(ids, texts, each(texts))`` over runs of texts of about FIELD_CHARS; null and empty texts are none."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= FIELD_CHARS or b + 1 == len(texts):
            yield ids[a : b + 1], texts[a : b + 1], each([t or "" for t in texts[a : b + 1]])
            a, size = b + 1, 0


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each find replaced by the placeholder of its kind; the rest stays as it is."""
    parts, at = [], 0
    for a, b, kind in found:
        if a >= at:
            parts += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join(parts) + text[at:]


def fit_model(documents: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> Model:
    """The model for a table of ``doc_id, text`` and a lexicon of ``name_word, name_kind`` (both may hold nulls and repeats)."""
    words = lexicon.select("name_word", "name_kind").where("name_word IS NOT NULL AND name_kind IS NOT NULL").distinct().limit(MAX_LEXICON + 1).collect()
    if len(words) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} names")
    lexicon_words = sorted((r.name_word, r.name_kind) for r in words)
    some = documents.select("doc_id", "text").where(F.length("text") > 0)
    texts = [r.text for r in some.where(F.length("text") <= MAX_TEXT).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()]
    return learn(texts, lexicon_words, corpus=count_corpus(some, *lexicon_sets(lexicon_words)))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Stores a fitted model, so that a corpus is learned from once and read by many jobs."""
    plain = {k: sorted(v) if isinstance(v, frozenset) else v for k, v in model.__getstate__().items()}
    spark.createDataFrame([(json.dumps(plain),)], "value string").write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    stored = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return Model(**{k: frozenset(v) if isinstance(v, list) else v for k, v in stored.items()})


def count_corpus(documents: DataFrame, given: set[str], family: set[str]) -> Corpus:
    """:func:`corpus_of` for all texts of a table; words that can't change the model stay in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys, values = zip(*out.items())
            columns = [pa.array(c, pa.string()) for c in zip(*keys)] + [pa.array(c, pa.int64()) for c in zip(*values)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "family", *COUNTS])

        out = count_words([], given, family)
        for b in batches:
            count_words([t for t in b.column(0).to_pylist() if t], given, family, out)
            if len(out) > 200_000:
                yield rows()
                out.clear()
        if out:
            yield rows()

    spark = documents.sparkSession
    sums = [F.sum(c).alias(c) for c in COUNTS]
    parts = documents.select("text").mapInArrow(run, "word string, family string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    path = shared_dir(spark, "name-counts")
    parts.groupBy("word", "family").agg(*sums).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.where("word = ''").select("n").first()
    texts = total.n if total else 0
    known = spark.createDataFrame([(w,) for w in sorted(given | family)], "word string")
    plain = plain_words({r.word: (r.n, r.lower, r.before, r.after) for r in counts.where("family = ''").join(known, "word").collect()}, given, family, texts)
    sure = counts.where("word != ''").join(spark.createDataFrame([(w,) for w in sorted(plain)], "family string"), "family", "left_anti")
    kept = sure.groupBy("word").agg(*sums).where(
        (F.col("n") >= at_least(4, texts))
        | (F.col("lower") <= 0.5 * F.col("n")) & ((F.col("beside") >= 2) & (F.col("beside") >= 0.34 * F.col("n")) | (F.col("after") >= 2) & (F.col("after") >= 0.5 * F.col("n")))
    ).limit(MAX_WORDS + 1).toArrow().to_pylist()
    if len(kept) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words that are frequent or may be names")
    return Corpus(texts, plain, {r["word"]: tuple(r[c] for c in COUNTS) for r in kept})


def find_personal(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, kind, found_text``: one row per document, kind and distinct text.

    A null or empty text has no finds. Documents that share an id count as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, found in _in_fields(b.column(0).to_pylist(), b.column(1).to_pylist(), lambda t: find_in(t, model)):
                rows = [(i, kind, x) for i, text, spans in zip(ids, texts, found) for kind, x in {(kind, text[s:e]) for s, e, kind in spans}]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "found_text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, found_text string").distinct()


def span_marginals(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start_at, end_at, kind, probability``: the field's marginal of every node of every document and each kind it may be.

    Places count characters from 0. Null and empty texts have no nodes.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, found in _in_fields(b.column(0).to_pylist(), b.column(1).to_pylist(), lambda t: marginals_in(t, model)):
                columns = list(zip(*((i, *x) for i, rows in zip(ids, found) for x in rows))) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start_at", "end_at", "kind", "probability"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_at bigint, end_at bigint, kind string, probability double")


def redact_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text``: every document, each find replaced by its placeholder; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, found in _in_fields(b.column(0).to_pylist(), b.column(1).to_pylist(), lambda t: find_in(t, model)):
                clean = [redact(t, f) if t else t for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")

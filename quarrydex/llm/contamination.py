"""Evaluation texts inside a corpus (template canonicalisation).

Words become template tokens: a number, a unit or a name turns into a typed placeholder,
any other word stands for itself. Each word is typed on its own, so equal words always get
equal tokens: numbers are words with a digit and number words, units are listed, names are
words that the test items mostly write with a capital inside a sentence, and words that too few items
share. Windows of ``WINDOW`` template tokens of documents and items are joined by hash; a window with fewer
than ``MIN_LITERAL`` words that stand for themselves has no template worth the name and is joined by its words.
The slots (the words behind the placeholders) decide: equal slots are an exact leak, which the words then confirm;
slots that differ, but are of the same kinds and equal to each other in the same places, are a
re-parameterised question.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
#: A word shared by fewer items is a name; fewer words of a window that stand for themselves make no template.
MIN_ITEMS, MIN_LITERAL = 5, 4
#: Share of a word's places inside a sentence from which on, written with a capital, it is a name.
TITLED = 0.8
#: Template words that may be sent to every task; more are refused.
MAX_WORDS = 1_000_000
#: Bits of the filter of item windows that is sent to every executor: for each window, at least and at most.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
#: Words that a task remembers besides, and characters of texts that it takes at once.
MAX_KNOWN, CHARS = 500_000, 2_000_000
#: Words that are units, and words that are numbers.
UNITS = "ms s seconds second minutes minute hours hour days day weeks week months month years year bytes byte kb mb gb tb percent km m cm mm kg g"
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
)
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"

TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")
ODD = re.compile(r"[^\x00-\x7f]")
#: A word inside a sentence: behind a word, perhaps with a comma.
INSIDE = re.compile(r"(?:(?<=[^\W_][ \u00a0])|(?<=[^\W_][,;][ \u00a0]))[^\W\d_]+")


@lru_cache(maxsize=1)
def format_characters() -> dict[int, None]:
    """Code points of Unicode category Cf, for deletion."""
    return {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf"}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, case-folded, without tags and format characters, after NFKC."""
    if ODD.search(text):
        text = unicodedata.normalize("NFKC", TAG.sub("", text.translate(format_characters())))
        return WORD.findall(text.casefold())
    return WORD.findall(TAG.sub("", text).lower())


def _number(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


class Canon:
    """Words to template tokens."""

    def __init__(self, vocabulary: frozenset[str]) -> None:
        numbers = set(NUMBERS.split())
        self.number, self.name, self.unit = (_number(NUMBER), True), (_number(NAME), True), (_number(UNIT), True)
        self.tokens = {w: (_number(w), False) for w in vocabulary if not any(c.isdigit() for c in w)}
        self.tokens |= {w: self.unit for w in UNITS.split()} | {w: self.number for w in numbers}
        self.most = len(self.tokens) + MAX_KNOWN

    def __call__(self, word: str) -> tuple[int, bool]:
        """The token's hash, and whether it is a slot."""
        t = self.tokens.get(word)
        if t is None:
            t = self.number if any(c.isdigit() for c in word) else self.name
            if len(self.tokens) < self.most:
                self.tokens[word] = t
        return t


def window_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of each run of ``WINDOW`` tokens (one fewer result for each token past the first)."""
    n = len(tokens) - WINDOW + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
            out ^= out >> np.uint64(29)
    return out


def templates(words: list[str], canon: Canon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window the template's hash, and whether it is a template (else the hash is that of the words); of each word token and slot.

    Each distinct word is typed once.
    """
    d = pc.dictionary_encode(pa.array(words, pa.large_string()))
    own = d.dictionary.to_pylist()
    typed = [canon(w) for w in own]
    at = d.indices.to_numpy()
    tokens, slots = np.array([t for t, _ in typed], dtype=np.uint64)[at], np.array([s for _, s in typed], dtype=bool)[at]
    hashes = window_hashes(tokens)
    literal = np.concatenate([[0], np.cumsum(~slots)])
    enough = literal[WINDOW:] - literal[:-WINDOW] >= MIN_LITERAL
    if not enough.all():
        hashes = np.where(enough, hashes, ~window_hashes(np.array([_number(w) for w in own], dtype=np.uint64)[at]))
    return hashes.view(np.int64), enough, tokens, slots


def filter_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of ``bits`` (a power of two)."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(bits - 1)).view(np.int64), ((h >> np.uint64(34)) & np.uint64(bits - 1)).view(np.int64)


def shape_of(slots: list[str], kinds: list[int]) -> str:
    """The slots' kinds, and which are equal to each other: 'a b a' -> '0 1 0'."""
    seen: dict[str, int] = {}
    return " ".join(f"{seen.setdefault(s, len(seen))}" for s in slots) + "/" + "".join(str(k % 7) for k in kinds)


SCHEMA = "id bigint, pos int, template bigint, shape string, slots string, words string"


def _windows(vocabulary: Broadcast, filter_: Broadcast | None):
    """Windows of the texts in ``(id, text)``, only those whose template the filter may hold."""

    def windows(canon: Canon, bits: np.ndarray | None, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        """The windows of some texts, all at once."""
        words: list[str] = []
        ends = []
        for text in texts:
            words += words_of(text) if text else ()
            ends.append(len(words))
        if len(words) < WINDOW:
            return
        hashes, enough, tokens, slots = templates(words, canon)
        keep = np.ones(len(hashes), dtype=bool)
        for end in ends:  # windows that go on into the next text are none
            keep[max(0, end - WINDOW + 1) : end] = False
        if bits is not None:
            first, second = filter_places(hashes, 8 * len(bits))
            keep &= (bits[first >> 3] >> (first & 7).astype(np.uint8) & bits[second >> 3] >> (second & 7).astype(np.uint8) & 1).astype(bool)
        rows: list[tuple] = []
        hits = np.flatnonzero(keep)
        for p, text in zip(hits.tolist(), np.searchsorted(ends, hits, side="right").tolist()):
            mine, shape = [], None
            if enough[p]:
                at = (np.flatnonzero(slots[p : p + WINDOW]) + p).tolist()
                mine = [words[i] for i in at]
                shape = shape_of(mine, tokens[at].tolist())
            rows.append((ids[text], p - (ends[text - 1] if text else 0), int(hashes[p]), shape, " ".join(mine), " ".join(words[p : p + WINDOW])))
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(vocabulary.value)
        bits = None if filter_ is None else filter_.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            a = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > CHARS or i + 1 == len(texts):
                    yield from windows(canon, bits, ids[a : i + 1], texts[a : i + 1])
                    a, size = i + 1, 0

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "pos", "template", "shape", "slots", "words"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words; how often each stands inside a sentence there, and with a capital."""
    for b in batches:
        columns: list[list] = [[], [], [], []]
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = TAG.sub("", text or "")
            inside: dict[str, list[int]] = {}
            for w in INSIDE.findall(text):
                n = inside.setdefault(w.casefold(), [0, 0])
                n[0] += 1
                n[1] += w[0].isupper() and not text.isupper()
            for w in set(words_of(text)):
                for c, x in zip(columns, (i, w, *inside.get(w, (0, 0)))):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["id", "word", "inside", "titled"])


def template_words(items: DataFrame, min_items: int = MIN_ITEMS) -> frozenset[str]:
    """Words that stand for themselves: of at least ``min_items`` items, and not mostly written with a capital inside sentences.

    More than MAX_WORDS are refused, never dropped.
    """
    once = items.mapInArrow(_split, "id bigint, word string, inside bigint, titled bigint").groupBy("word", "id").agg(F.max("inside").alias("inside"), F.max("titled").alias("titled"))
    counts = once.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("inside").alias("inside"), F.sum("titled").alias("titled"))
    plain = counts.where((F.col("n") >= min_items) & ((F.col("titled") == 0) | (F.col("titled") < F.col("inside") * F.lit(TITLED))))
    found = plain.select("word").limit(MAX_WORDS + 1).toArrow().column(0).to_pylist()
    if len(found) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words that stand for themselves; raise min_items")
    return frozenset(found)


def window_filter(own: DataFrame) -> np.ndarray:
    """A Bloom filter of the windows' templates, as bytes: BITS_EACH bits a template, within MIN_BITS and MAX_BITS.

    Its words are put together in the cluster, so that at most MAX_BITS bits come to the driver. More templates
    than it has room for make it pass more windows to the join, which decides.
    """
    distinct = own.select("template").distinct()
    n = distinct.count()
    bits = min(max(1 << (max(n, 1) * BITS_EACH - 1).bit_length(), MIN_BITS), MAX_BITS)
    low = F.col("template").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("template", 34).bitwiseAND(F.lit(bits - 1))
    places = distinct.select(F.explode(F.array(low, high)).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _texts(df: DataFrame) -> DataFrame:
    x = df.select(df.columns[0], df.columns[1])
    return x.select(x[0].cast("bigint").alias("id"), x[1].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _item_windows(items: DataFrame) -> tuple[DataFrame, Broadcast]:
    x = _texts(items)
    vocabulary = items.sparkSession.sparkContext.broadcast(template_words(x))
    return x.mapInArrow(_windows(vocabulary, None), SCHEMA), vocabulary


def template_hits(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(document windows, item windows)``, the former those whose template passes a filter of the items' templates.

    Both inputs are ``(id, text)``. All documents are read once, and only what passes the filter leaves a task.
    """
    own, vocabulary = _item_windows(items)
    filter_ = items.sparkSession.sparkContext.broadcast(window_filter(own))
    return _texts(documents).mapInArrow(_windows(vocabulary, filter_), SCHEMA), own


def exact_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: at least ``WINDOW`` words in a row of the item stand in the document.

    Template and slots are the join key; the words themselves confirm each match. Texts
    with fewer words have no windows; null ids and texts are left out; repeated rows and
    matches give one row. Documents that are copies of each other are reported each.
    """
    d, i = template_hits(documents, items)
    i = i.select(F.col("id").alias("item_id"), "template", "slots", "words").distinct()
    d = d.select(F.col("id").alias("doc_id"), "template", "slots", "words")
    return d.join(i, ["template", "slots", "words"]).select("doc_id", "item_id").distinct()


def template_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold a question's template, its slots perhaps filled anew; one window is enough.

    ``doc_id, template_item, windows, same_words``: ``template_item`` is the smallest item
    with the template window (the representative of all that share it; see :func:`template_members`),
    ``windows`` the number of the document's windows with that representative and consistent slots,
    ``same_words`` those that stand in some item word by word. The windows of one passage
    may have different representatives and give a row for each, so no row is dropped for a small count. A window
    with too few words that stand for themselves counts if it stands in an item word by word.
    """
    d, i = template_hits(documents, items)
    shape = lambda df: df.withColumn("shape", F.coalesce("shape", F.concat(F.lit("="), "words")))
    d, i = shape(d), shape(i)
    rep = i.groupBy("template", "shape").agg(F.min("id").alias("template_item"))
    exact = i.select("template", "slots", "words", F.lit(1).alias("same")).distinct()
    hits = d.select(F.col("id").alias("doc_id"), "pos", "template", "shape", "slots", "words").distinct()
    hits = hits.join(rep, ["template", "shape"]).join(exact, ["template", "slots", "words"], "left")
    return hits.groupBy("doc_id", "template_item").agg(F.count(F.lit(1)).alias("windows"), F.count("same").alias("same_words"))


def template_members(items: DataFrame) -> DataFrame:
    """``template_item, item_id``: which items share a template window with its representative."""
    own = _item_windows(items)[0].withColumn("shape", F.coalesce("shape", F.concat(F.lit("="), "words")))
    rep = own.groupBy("template", "shape").agg(F.min("id").alias("template_item"))
    return own.join(rep, ["template", "shape"]).select("template_item", F.col("id").alias("item_id")).distinct()

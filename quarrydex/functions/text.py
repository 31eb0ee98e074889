"""The English analyzer as columns: words, stop words, stems, k-grams."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from quarrydex.functions.porter2 import stem

#: A word is a run of letters and digits.
WORD = r"([\p{L}\p{N}]+)"
GRAM = 3


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """Spark's English stop words; needs an active session."""
    if SparkSession.getActiveSession() is None:
        raise RuntimeError("the stop words come from Spark; start a session first")
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def raw_words(text: Column) -> Column:
    """Lower-case words of a text in order, repeats kept; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def content_words(text: Column) -> Column:
    """:func:`raw_words` without stop words; positions count these words."""
    stops = sorted(stop_words())
    return F.filter(raw_words(text), lambda w: ~w.isin(stops))


@arrow_udf(ArrayType(StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Every word of every array stemmed; each distinct word of a batch is stemmed once."""
    d = pc.dictionary_encode(words.flatten())
    stems = pa.array([None if w is None else stem(w) for w in d.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(d.indices), mask=pc.is_null(words))


def analyze(text: Column) -> Column:
    """A text's terms in order: words, without stop words, stemmed."""
    return stem_words(content_words(text))


_PY_WORD = re.compile(r"[^\W_]+")


def analyze_text(text: str) -> list[str]:
    """:func:`analyze` for one string, on the driver (query words)."""
    stops = stop_words()
    return [stem(w) for w in _PY_WORD.findall(text.lower()) if w not in stops]


def normalize_word(word: str) -> str:
    """The first term of a query word; '' if none is left."""
    return next(iter(analyze_text(word)), "")


def normalize_pattern(s: str) -> str:
    """Lower case, all but letters, digits and ``*`` deleted; neither stop words nor stems."""
    return "".join(c for c in s.lower() if c.isalnum() or c == "*")


def term_grams(term: Column, k: int = GRAM) -> Column:
    """Distinct ``k``-byte pieces of ``$term$``; an empty array where there are none."""
    padded = F.encode(F.concat(F.lit("$"), term, F.lit("$")), "UTF-8")
    n = F.length(padded) - (k - 1)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)).cast("string"))
    return F.when(n >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _pieces(s: str, k: int) -> list[str]:
    """Distinct ``k``-byte pieces; those that cut a character in two are left out, as no string could stand for them."""
    b = s.encode()
    pieces = (b[i : i + k].decode("utf-8", "ignore") for i in range(len(b) - k + 1))
    return list(dict.fromkeys(p for p in pieces if len(p.encode()) == k))


def prefix_grams(prefix: str, k: int = GRAM) -> list[str]:
    """Grams every term with this prefix has."""
    return _pieces("$" + prefix, k)


def pattern_grams(pattern: str, k: int = GRAM) -> list[str]:
    """Grams every term matching the wildcard pattern has."""
    return [g for g in _pieces("$" + pattern + "$", k) if "*" not in g]

"""quarrydex: full-text, temporal and key/value analytics as Spark plans.

Sub-packages
------------
functions   scalar text functions (tokenising, stop words, stemming, k-grams, Bloom hashing)
plans       query language (lexer, parser, syntax tree) and its compilation to columns
operators   index building and searching, key/value replay, skew-safe profiles
sources     tables, persisted index segments and their compaction
streaming   incremental ingest
"""

__version__ = "0.1.0"

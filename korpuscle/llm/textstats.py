"""Statistics of whole texts that the quality operators share.

Words are runs of characters other than space and U+0009 to U+000D. A null text counts as
empty: all counts are zero and all ratios too.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, columns_of, to_batch

#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
BLANKS = " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "mean_word", "symbols_per_char", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "shouts_per_word",
    "pipes_per_word", "twin_ratio", "distinct_ratio", "lines_per_word", "letter_ratio", "points_per_word", "top_word_ratio",
)


def repeated_words(words: list, width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more, the first included."""
    grams = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    total, end = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            total += i + width - max(i, end)
            end = i + width
    return total


def text_stats(text: str | None) -> tuple:
    """COUNTS, then RATIOS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at exactly these six characters
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    again = repeated_words(words)
    if not n:
        return (0, word_chars, symbols, dup, again, *[0.0] * len(RATIOS))
    size = len(raw)
    upper, digits = (size - len(raw.translate(None, x)) for x in (_UPPER, _DIGITS))
    letters = upper + size - len(raw.translate(None, _LOWER + _HIGH))
    kinds = Counter(words)
    return (
        n, word_chars, symbols, dup, again,
        math.log1p(n), word_chars / n, symbols / word_chars, dup / len(lines), again / n, upper / max(letters, 1), digits / size, text.count("!") / n,
        text.count("|") / n, sum(map(eq, words, words[1:])) / n, len(kinds) / n, len(lines) / n, letters / size, sum(map(text.count, ".,;:")) / n, max(kinds.values()) / n,
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text."""
    bounded_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in RATIOS)]
    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in fields)
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            yield to_batch(schema, [(i, *text_stats(t)) for i, t in zip(*columns_of(batch, "doc_id", "text"), strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def with_stats(docs: DataFrame, prefix: str) -> DataFrame:
    """docs, all columns, with the statistics as columns of prefixed names."""
    bounded_batches(docs.sparkSession)
    names = [(prefix + c, "long") for c in COUNTS] + [(prefix + c, "double") for c in RATIOS]
    ddl = ", ".join(f"{n} {t}" for n, t in names)
    at = docs.columns.index("text")
    types = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)

    def run(batches):
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(at).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            more = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(n for n, _ in names)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(ddl).fields]))

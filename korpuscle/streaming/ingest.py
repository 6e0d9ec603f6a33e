"""An extension: documents as a stream to tokens, and windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_word, tokens_of


def token_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, word, word_lc, is_word) of a batch or stream of (doc_id, text); stateless."""
    split = docs.select("doc_id", F.posexplode(tokens_of(F.col("text"))).alias("tok_idx", "word"))
    return split.select("doc_id", "tok_idx", "word", F.lower("word").alias("word_lc"), is_word(F.col("word")).alias("is_word"))


def term_counts(events: DataFrame, term: str, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of a column's values in tumbling or sliding windows, with late rows up to the watermark."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(span.alias("w"), F.col(term).alias("term")).agg(F.count("*").alias("n")).select("w.start", "w.end", "term", "n")


def sessions(events: DataFrame, key: str, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key, closed by a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")

"""Tokenizer, word-token test and folding, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores, or one other character that is no space.
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
SENTENCE_ENDS = (".", "!", "?")


def tokens_of(text: Column) -> Column:
    """Array of tokens; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def spaced_tokens_of(text: Column) -> Column:
    """Array of tokens, each with the white space that follows it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN + r"\s*"), F.lit(0))


def is_word(token: Column) -> Column:
    """A word token holds a letter or digit after trimming and is no |marker|."""
    t = F.trim(token)
    return t.rlike(r"[\p{L}\p{N}]") & ~t.rlike(r"^\|.*\|$")


def wildcard_regex(pattern: str) -> str:
    """``*`` is any run and ``?`` any one character; the whole form must match."""
    out = "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c) for c in pattern)
    return f"(?su)^{out}$"


def sort_fold(c: Column) -> Column:
    """Folding of the concordance sort: lower case, umlauts to vowels, sharp s to ss."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "äöü", "aou")


def formula_guard(c: Column) -> Column:
    """A leading quote before cells that a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


#: Fixed patterns of personal data in display text, in the order that they are masked.
PII = {
    "[email]": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "[ip]": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "[card]": r"\b[0-9]{13,16}\b",
    "[phone]": r"\+?[0-9]{1,3}[ -]?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}",
}


def mask_pii(c: Column) -> Column:
    for name, pattern in PII.items():
        c = F.regexp_replace(c, pattern, name)
    return c

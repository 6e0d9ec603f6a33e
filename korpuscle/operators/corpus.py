"""The corpus: a token table and a document table, and the scopes cut from it.

Documents are dealt by ``doc_id`` before they are split into tokens. The texts move once
and the tokens never: every window partitioned by document, or by document and sentence,
finds its rows in place, and Catalyst plans no exchange for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_ENDS, is_word, spaced_tokens_of, tokens_of

#: Attributes of a token that queries may name, and their columns.
ATTRIBUTES = {"word": "word", "lemma": "lemma", "pos": "pos_tag", "morph": "morph", "ent": "ent", "rel": "rel"}


def by_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("tok_idx")


def by_sentence() -> Window:
    return Window.partitionBy("doc_id", "sent_id").orderBy("tok_idx")


def unit(within: str):
    """The window of a scope name: ``s`` for sentences, ``doc`` for documents."""
    if within not in ("s", "doc"):
        raise ValueError(f"unknown unit {within!r}; use s or doc")
    return by_sentence() if within == "s" else by_document()


class Corpus:
    """tokens: doc_id, tok_idx, sent_id, word, word_lc, lemma, pos_tag, is_word and more;
    docs: doc_id, its metadata columns, n_tokens, n_words."""

    def __init__(self, tokens: DataFrame, docs: DataFrame, meta: list[str]):
        self.tokens, self.docs, self.meta = tokens, docs, meta
        self.again: Callable[[DataFrame], Corpus] | None = None  # splits the texts of a docset anew

    @classmethod
    def from_documents(cls, df: DataFrame, meta: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", persist: bool = False, spacing: bool = False, deal: bool = True) -> Corpus:
        """Split texts into tokens under the blank pipeline: lemma is the folded word, POS is X.

        Without ``deal``, texts stay where they are: for counts without windows, or windows over few tokens, which then move themselves.
        With ``spacing``, ws_after tells the tokens that white space follows in the source.
        """
        meta = [c for c in df.columns if c not in (id_col, text_col)] if meta is None else meta
        base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *meta)
        base = base.repartition("doc_id") if deal else base
        split = base.select("doc_id", *meta, F.posexplode((spaced_tokens_of if spacing else tokens_of)(F.col("text"))).alias("tok_idx", "word"))
        if spacing:
            split = split.withColumn("ws_after", F.col("word").rlike(r"\s$")).withColumn("word", F.regexp_replace("word", r"\s+$", ""))
        ends = F.sum(F.col("word").isin(*SENTENCE_ENDS).cast("int")).over(by_document().rowsBetween(Window.unboundedPreceding, -1))
        word_lc = F.lower("word")
        tokens = split.select(
            "doc_id", *meta, "tok_idx", F.coalesce(ends, F.lit(0)).cast("int").alias("sent_id"), "word", word_lc.alias("word_lc"), is_word(F.col("word")).alias("is_word"),
            *(["ws_after"] if spacing else []),
        )
        if persist:
            tokens = tokens.persist(StorageLevel.MEMORY_AND_DISK)
        sizes = tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("is_word").alias("n_words"))
        docs = df.select(F.col(id_col).alias("doc_id"), *meta).join(sizes, "doc_id", "left")
        docs = docs.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_tokens", "n_words")})
        out = cls(tokens.withColumns({"lemma": F.col("word_lc"), "pos_tag": F.lit("X")}), docs, meta)
        if not persist:
            out.again = lambda ids: cls.from_documents(df.join(ids.select(F.col("doc_id").alias(id_col)), id_col, "left_semi"), meta, id_col, text_col, spacing=spacing)
        return out

    @classmethod
    def from_tokens(cls, tokens: DataFrame, docs: DataFrame | None = None) -> Corpus:
        """A corpus from annotated tokens (doc_id, tok_idx, word and any of sent_id, lemma, pos_tag, morph, ent, rel, head_idx)."""
        have = set(tokens.columns)
        ends = F.sum(F.col("word").isin(*SENTENCE_ENDS).cast("int")).over(by_document().rowsBetween(Window.unboundedPreceding, -1))
        defaults: dict[str, Column] = {"word_lc": F.lower("word"), "is_word": is_word(F.col("word")), "lemma": F.lower("word"), "pos_tag": F.lit("X"), "sent_id": F.coalesce(ends, F.lit(0)).cast("int")}
        tokens = tokens.withColumns({k: v for k, v in defaults.items() if k not in have})
        sizes = tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("is_word").alias("n_words"))
        meta = [c for c in docs.columns if c != "doc_id"] if docs is not None else []
        return cls(tokens, docs.join(sizes, "doc_id", "left").na.fill(0, ["n_tokens", "n_words"]) if docs is not None else sizes, meta)

    def attributes(self) -> dict[str, str]:
        """Capabilities: the attributes that this corpus has."""
        return {a: c for a, c in ATTRIBUTES.items() if c in self.tokens.columns}

    def column(self, attribute: str) -> str:
        have = self.attributes()
        if attribute not in have:
            raise ValueError(f"the corpus has no attribute {attribute!r}; it has {', '.join(sorted(have))}")
        return have[attribute]

    def scope(self, docset: DataFrame) -> Corpus:
        """The corpus cut to a docset, numerators and denominators alike."""
        ids = docset.select("doc_id").distinct()
        if self.again is not None:  # the other texts are not split
            return self.again(ids)
        return Corpus(self.tokens.join(ids, "doc_id", "left_semi"), self.docs.join(ids, "doc_id", "left_semi"), self.meta)

    def totals(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))

    def lexicon(self, attribute: str = "word") -> DataFrame:
        """value, value_lc and freq of an attribute."""
        c = self.column(attribute)
        return self.tokens.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("freq")).withColumn("value_lc", F.lower("value"))

    def suggest(self, prefix: str, attribute: str = "word", k: int = 10) -> DataFrame:
        """The commonest values that start with a prefix."""
        return self.lexicon(attribute).where(F.col("value_lc").startswith(prefix.lower())).orderBy(F.desc("freq"), "value").limit(k)

"""Frequency lists, n-grams, contrasts, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import over
from .corpus import Corpus, by_document


def labels(corpus: Corpus) -> DataFrame:
    """word_lc and the commonest surface in this corpus; ties go to the least."""
    surfaces = corpus.tokens.where("is_word").groupBy("word_lc", "word").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("word")))
    return surfaces.groupBy("word_lc").agg(best["word"].alias("label"))


def frequency(corpus: Corpus, attr: str = "word", docset: DataFrame | None = None, stopwords: list[str] | None = None, pos: str | None = None, with_labels: bool = True) -> DataFrame:
    """Folded frequencies of word tokens (word, lemma), or of tags over all tokens (pos)."""
    scoped = corpus if docset is None else corpus.scope(docset)
    if attr == "pos":
        return scoped.tokens.groupBy(F.col("pos_tag").alias("key")).agg(F.count("*").alias("freq"))
    rows = scoped.tokens.where("is_word")
    if pos is not None:
        rows = rows.where(F.col("pos_tag") == pos)
    key = F.col("word_lc") if attr == "word" else F.lower(corpus.column(attr))
    out = rows.groupBy(key.alias("key")).agg(F.count("*").alias("freq"))
    if stopwords:
        out = out.where(~F.col("key").isin([s.lower() for s in stopwords]))
    if attr == "word" and with_labels:  # the label is that of the whole corpus, whatever the scope
        out = out.join(labels(corpus).withColumnRenamed("word_lc", "key"), "key")
    return out


def ngrams(corpus: Corpus, n: int, min_freq: int = 1) -> DataFrame:
    """Exact n-grams of word tokens within a document, across sentences."""
    if not 1 <= n <= 5:
        raise ValueError("n goes from 1 to 5")
    w = by_document()
    rows = corpus.tokens.select("doc_id", "tok_idx", F.when(F.col("is_word"), F.col("word")).alias("w0"))
    ahead = [F.col("w0"), *[F.lead("w0", k).over(w) for k in range(1, n)]]
    whole = rows.select(*[c.alias(f"w{k}") for k, c in enumerate(ahead)]).na.drop()
    out = whole.select(F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("freq"))
    return out if min_freq <= 1 else out.where(F.col("freq") >= min_freq)


def ngram_positions(corpus: Corpus, n: int) -> DataFrame:
    """Places an n-gram could stand, over all tokens."""
    return corpus.docs.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n_tokens") - (n - 1))), F.lit(0)).cast("long").alias("positions"))


def sides(corpus: Corpus, target: Column, reference: Column) -> Corpus:
    """The corpus cut to two sides, marked t and r; a document on both is an error of the caller."""
    side = F.when(target, F.lit("t")).when(reference, F.lit("r"))
    tokens = corpus.tokens.withColumn("side", side).where(F.col("side").isNotNull())
    docs = corpus.docs.withColumn("side", side).where(F.col("side").isNotNull())
    return Corpus(tokens, docs, [*corpus.meta, "side"])


def _side_sums(of: Column, name: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("side") == s, of)), F.lit(0)).alias(f"{name}_{s}") for s in "tr"]


def frequency_contrast(corpus: Corpus, target: Column, reference: Column, min_freq: int = 5) -> DataFrame:
    """Rates per million word tokens on two sides; rows with a frequency of min_freq on either."""
    two = sides(corpus, target, reference)
    counts = two.tokens.where("is_word").groupBy("word_lc").agg(*_side_sums(F.lit(1), "f")).where(F.greatest("f_t", "f_r") >= min_freq)
    totals = two.docs.agg(*_side_sums(F.col("n_words"), "n"))
    return _rates(counts.crossJoin(F.broadcast(totals)), "word_lc")


def _rates(df: DataFrame, key: str) -> DataFrame:
    rate = lambda s: over(1e6 * F.col(f"f_{s}").cast("double"), F.col(f"n_{s}"))
    diff = rate("t") - rate("r")
    return df.select(key, "f_t", "f_r", rate("t").alias("pm_t"), rate("r").alias("pm_r"), diff.alias("diff_pm"), F.abs(diff).alias("diff_abs"))


def ngram_contrast(corpus: Corpus, target: Column, reference: Column, n: int = 2, min_freq: int = 5) -> DataFrame:
    """As frequency_contrast, per million n-gram places."""
    two = sides(corpus, target, reference)
    w = by_document()
    rows = two.tokens.select("doc_id", "tok_idx", "side", F.when(F.col("is_word"), F.col("word")).alias("w0"))
    whole = rows.select("side", *[(F.col("w0") if k == 0 else F.lead("w0", k).over(w)).alias(f"w{k}") for k in range(n)]).na.drop()
    counts = whole.select("side", F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("ngram")).groupBy("ngram").agg(*_side_sums(F.lit(1), "f"))
    totals = two.docs.agg(*_side_sums(F.greatest(F.lit(0), F.col("n_tokens") - (n - 1)), "n"))
    return _rates(counts.where(F.greatest("f_t", "f_r") >= min_freq).crossJoin(F.broadcast(totals)), "ngram")


def breakdown(corpus: Corpus, hits: DataFrame, fields: list[str], totals: bool = False) -> DataFrame:
    """Hits, documents with hits, words and rate by metadata values; with totals, rollup rows too."""
    per_doc = hits.groupBy("doc_id").agg(F.count("*").alias("h"))
    rows = corpus.docs.join(per_doc, "doc_id", "left")
    grouped = rows.rollup(*fields) if totals else rows.groupBy(*fields)
    out = grouped.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("n_hits"), F.count("h").alias("n_docs"), F.sum("n_words").alias("n_words"))
    return out.withColumn("per_million", F.when(F.col("n_words") > 0, 1e6 * F.col("n_hits").cast("double") / F.col("n_words").cast("double")))


def hit_spread(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """Documents with hits, the rate per word token and its interval with documents as clusters."""
    per_doc = hits.groupBy("doc_id").agg(F.count("*").alias("h"))
    d = corpus.docs.join(per_doc, "doc_id", "left").select(F.coalesce("h", F.lit(0)).cast("double").alias("h"), F.col("n_words").cast("double").alias("w"))
    s = d.agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("w").alias("w"), F.sum(F.col("h") * F.col("h")).alias("hh"), F.sum(F.col("h") * F.col("w")).alias("hw"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count_if(F.col("h") > 0).alias("n_docs"))
    r = over(F.col("h"), F.col("w"))
    residual = F.col("hh") - 2.0 * r * F.col("hw") + r * r * F.col("ww")
    n = F.col("n").cast("double")
    se = over(F.sqrt(F.greatest(F.lit(0.0), over(residual * n, n - 1.0))), F.col("w"))
    return s.select("n_docs", F.col("h").cast("long").alias("n_hits"), r.alias("rate"), F.greatest(F.lit(0.0), r - 1.959964 * se).alias("low"), (r + 1.959964 * se).alias("high"))


def rows_by_version(corpus: Corpus, hits: DataFrame, field: str) -> DataFrame:
    return hits.join(corpus.docs.select("doc_id", field), "doc_id").groupBy(field).agg(F.count("*").alias("n_hits"))


def alternative_lemmas(corpus: Corpus) -> DataFrame:
    """Counts of each reading of lemmas written a|b."""
    split = corpus.tokens.where(F.col("lemma").contains("|")).select("lemma", F.explode(F.split("lemma", r"\|")).alias("reading"))
    return split.where("reading <> ''").groupBy("lemma", "reading").agg(F.count("*").alias("freq"))


def docset_profile(corpus: Corpus, target: Column, reference: Column, fields: list[str]) -> DataFrame:
    """Documents and words of two docsets by value of each field: what else sets them apart."""
    two = sides(corpus, target, reference)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    rows = two.docs.select("side", "n_words", pairs).select("side", "n_words", "x.field", "x.value")
    return rows.groupBy("field", "value").agg(*_side_sums(F.lit(1), "docs"), *_side_sums(F.col("n_words"), "words"))

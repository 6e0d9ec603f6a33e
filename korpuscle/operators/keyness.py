"""Keyness of a target against a reference, with corrections for many tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, numeric
from .corpus import Corpus
from .counting import sides


def bonferroni(p: Column, m: Column) -> Column:
    return F.least(F.lit(1.0), p * m)


def with_bh(rows: DataFrame, p: str = "p", key: str = "word_lc", name: str = "q") -> DataFrame:
    """Benjamini-Hochberg step-up over all rows; adds m, their number, too.

    Ranks and running minima are taken inside buckets of p, with the buckets' own totals
    carried between them, so no task sees all rows.
    """
    c = F.col(p)
    small = 3000 - F.least(F.lit(3000.0), F.floor(-9.0 * F.log10(F.greatest(c, F.lit(1e-320)))))
    bucket = F.when(c > 0.01, 3000 + F.floor(c * 1024)).otherwise(small).cast("int")
    b = rows.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    under = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = sizes.select("_b", under.alias("_base"), whole.alias("m"))
    b = b.join(F.broadcast(base), "_b")
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy(p, key))
    b = b.withColumn("_q", c * F.col("m") / rank)
    least = b.groupBy("_b").agg(F.min("_q").alias("_l"))
    above = least.select("_b", F.min("_l").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    down = Window.partitionBy("_b").orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(above), "_b").withColumn(name, F.least(F.lit(1.0), F.min("_q").over(down), F.col("_above")))
    return out.drop("_b", "_base", "_q", "_above")


def count_sides(corpus: Corpus, target: Column, reference: Column, min_freq: int = 5, pos: str | None = None) -> DataFrame:
    """word_lc, a, c, nt, nr: one pass, the two sides as conditional counts."""
    two = sides(corpus, target, reference)
    rows = two.tokens.where("is_word")
    if pos is not None:
        rows = rows.where(F.col("pos_tag") == pos)
    per = rows.groupBy("word_lc").agg(F.count_if(F.col("side") == "t").alias("a"), F.count_if(F.col("side") == "r").alias("c"))
    totals = per.agg(F.sum("a").alias("nt"), F.sum("c").alias("nr"))
    return per.where(F.col("a") + F.col("c") >= min_freq).crossJoin(F.broadcast(totals))


def keyness(corpus: Corpus, target: Column, reference: Column | None = None, min_freq: int = 5, pos: str | None = None, inference: bool = True) -> DataFrame:
    """Every keyness statistic of every word; the reference is the rest of the corpus if none is given."""
    reference = ~target if reference is None else reference
    return scored(count_sides(corpus, target, reference, min_freq, pos), inference)


def scored(rows: DataFrame, inference: bool = True) -> DataFrame:
    out = rows.withColumns(measures.keyness(*(F.col(x) for x in ("a", "c", "nt", "nr"))))
    if not inference:
        return out
    # the costly kernel comes before the buckets of with_bh, which hold words unevenly
    out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_m")))).withColumns({"p": numeric.p_value("ll"), "lrc": numeric.lrc("a", "c", "nt", "nr", "_m")}).drop("_m")
    return with_bh(out).withColumn("p_bonferroni", bonferroni(F.col("p"), F.col("m")))


def external(corpus: Corpus, reference: DataFrame, total: int, min_freq: int = 5) -> DataFrame:
    """Against a list (word, freq) of another corpus whose word tokens are ``total``."""
    listed = reference.groupBy(F.lower("word").alias("word_lc")).agg(F.sum("freq").cast("long").alias("c"))
    over = listed.agg(F.sum("c")).first()[0] or 0
    if over > total:
        raise ValueError(f"the reference list sums to {over}, more than its total of {total}")
    own = corpus.tokens.where("is_word").groupBy("word_lc").agg(F.count("*").alias("a"))
    nt = own.agg(F.sum("a").alias("nt"))
    rows = own.join(listed, "word_lc", "full").na.fill(0, ["a", "c"]).where(F.col("a") + F.col("c") >= min_freq)
    return scored(rows.crossJoin(F.broadcast(nt)).withColumn("nr", F.lit(total).cast("long")))


def variants(corpus: Corpus) -> DataFrame:
    """The spellings behind each folded word."""
    return corpus.tokens.where("is_word").groupBy("word_lc").agg(F.array_sort(F.collect_set("word")).alias("spellings"))

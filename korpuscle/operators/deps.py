"""Dependency operators: arcs, word sketches and their difference. Tokens carry rel and head_idx; a root is its own head."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures
from .corpus import Corpus

#: Relations that a sketch leaves out, in either direction.
DROPPED = ("ROOT", "punct", "case", "pnc")


def arcs(corpus: Corpus, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, dep_idx, head_idx, rel, dep, head), within a range of places if given."""
    t = corpus.tokens.where(F.col("head_idx") != F.col("tok_idx"))
    if first is not None:
        t = t.where(F.col("tok_idx").between(first, last) & F.col("head_idx").between(first, last))
    heads = corpus.tokens.select("doc_id", F.col("tok_idx").alias("head_idx"), F.col("word").alias("head"))
    return t.select("doc_id", F.col("tok_idx").alias("dep_idx"), "head_idx", "rel", F.col("word").alias("dep")).join(heads, ["doc_id", "head_idx"])


def node_form(corpus: Corpus, word: str) -> str:
    """The exact spelling if the corpus has it, else the lower-case one."""
    return word if not corpus.tokens.where(F.col("word") == word).isEmpty() else word.lower()


def sketch(corpus: Corpus, node: str, min_pairs: int = 3) -> DataFrame:
    """relation, word, f, f1, f2, n and scores; rel_rev rows hold the heads of the node."""
    form = node_form(corpus, node)
    links = arcs(corpus)
    pairs = links.where(F.col("head") == form).select(F.col("rel").alias("relation"), F.col("dep").alias("word"))
    pairs = pairs.unionByName(links.where(F.col("dep") == form).select(F.concat("rel", F.lit("_rev")).alias("relation"), F.col("head").alias("word")))
    pairs = pairs.where(~F.regexp_replace("relation", "_rev$", "").isin(*DROPPED))
    f = pairs.groupBy("relation", "word").agg(F.count("*").alias("f"))
    freq = corpus.tokens.groupBy("word").agg(F.count("*").alias("f2"), F.first("is_word").alias("is_word"))
    totals = freq.agg(F.sum(F.when(F.col("word") == form, F.col("f2")).otherwise(0)).alias("f1"), F.sum("f2").alias("n"))
    rows = f.join(freq, "word").crossJoin(F.broadcast(totals)).where(F.col("is_word") & ~F.col("word").rlike("^[@#]") & (F.col("f") >= min_pairs)).drop("is_word")
    # the node itself stays only where a relation has nothing else
    others = F.count_if(F.lower("word") != form.lower()).over(Window.partitionBy("relation"))
    rows = rows.withColumn("_others", others).where((F.lower("word") != form.lower()) | (F.col("_others") == 0)).drop("_others")
    o, f1, f2, n = (F.col(c).cast("double") for c in ("f", "f1", "f2", "n"))
    e = f1 * f2 / n
    ll = measures.g2(F.col("f"), F.col("f1"), F.col("f2"), F.col("n"))
    dice = 2.0 * o / (f1 + f2)
    rows = rows.withColumns({"chi2_cell": (o - e) * (o - e) / e, "t": (o - e) / F.sqrt(o), "ll": ll, "ll_signed": F.when(o >= e, ll).otherwise(-ll), "dice": dice, "logdice": 14.0 + F.log2(dice)})
    rank = Window.partitionBy("relation").orderBy(F.desc("logdice"), F.desc("ll"), F.desc("t"), F.desc("f"), F.desc("chi2_cell"), "word")
    return rows.withColumn("rank", F.row_number().over(rank))


def sketch_difference(a: DataFrame, b: DataFrame, score: str = "logdice", top_n: int = 10) -> DataFrame:
    """Rows of two sketches in three buckets: common (by the absolute difference), only_a, only_b."""
    left = a.select("relation", "word", F.col(score).alias("score_a"), F.col("f").alias("f_a"))
    both = left.join(b.select("relation", "word", F.col(score).alias("score_b"), F.col("f").alias("f_b")), ["relation", "word"], "full")
    bucket = F.when(F.col("score_b").isNull(), "only_a").when(F.col("score_a").isNull(), "only_b").otherwise("common")
    diff = F.col("score_a") - F.col("score_b")
    weight = F.coalesce(F.abs(diff), F.col("score_a"), F.col("score_b"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), "relation", "word"))
    return both.withColumns({"bucket": bucket, "diff": diff, "weight": weight}).withColumn("rank", rank).where(F.col("rank") <= top_n).drop("weight")

"""Documents ranked by search terms: tf, tf-idf, BM25."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus

K1, B = 1.5, 0.75


def search_documents(corpus: Corpus, terms: list[str], metric: str = "bm25", top_n: int | None = 20, case_sensitive: bool = True) -> DataFrame:
    """doc_id, score and first_idx of documents that hold every term.

    tf-idf takes one idf for the documents that hold all terms; it may be negative.
    """
    terms = list(dict.fromkeys(terms if case_sensitive else [t.lower() for t in terms]))
    if metric not in ("tf", "tf-idf", "bm25"):
        raise ValueError(f"unknown metric {metric!r}")
    if not terms:
        raise ValueError("no terms")
    key = F.col("word") if case_sensitive else F.col("word_lc")
    found = corpus.tokens.where(key.isin(terms))
    per = found.groupBy("doc_id").agg(*[F.count_if(key == t).alias(f"tf{i}") for i, t in enumerate(terms)], F.min("tok_idx").alias("first_idx"))
    stats = corpus.docs.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg_len"))
    per = per.join(corpus.docs.select("doc_id", "n_tokens"), "doc_id").crossJoin(F.broadcast(stats))
    tfs = [F.col(f"tf{i}").cast("double") for i in range(len(terms))]
    total = sum(tfs[1:], tfs[0])
    n, size = F.col("n").cast("double"), F.col("n_tokens").cast("double")
    whole = per.where(" and ".join(f"tf{i} > 0" for i in range(len(terms))))
    if metric == "tf":
        scored = whole.withColumn("score", total)
    elif metric == "tf-idf":
        df = whole.agg(F.count("*").cast("double").alias("df"))
        scored = whole.crossJoin(F.broadcast(df)).withColumn("score", total / size * F.log(n / (1.0 + F.col("df"))))
    else:
        dfs = per.agg(*[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))])
        whole = whole.crossJoin(F.broadcast(dfs))
        norm = K1 * (1.0 - B + B * size / F.col("avg_len"))
        parts = [F.log((n - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1.0) * tf * (K1 + 1.0) / (tf + norm) for i, tf in enumerate(tfs)]
        scored = whole.withColumn("score", sum(parts[1:], parts[0]))
    out = scored.select("doc_id", "score", "first_idx")
    return out if top_n is None else out.orderBy(F.desc("score"), "doc_id").limit(top_n)


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)

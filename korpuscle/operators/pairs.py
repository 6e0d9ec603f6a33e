"""Paired documents: groups, token edit distance, sentence alignment, annotator agreement."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_ENDS, tokens_of
from .corpus import Corpus

GAP, MIN_SIMILARITY, CELLS = 1.0, 0.5, 4_000_000


def groups(docs: DataFrame, key: str, role: str, anchor: str) -> DataFrame:
    """key, the anchor's doc_id and the doc_ids of its versions."""
    return docs.groupBy(key).agg(
        F.min(F.when(F.col(role) == anchor, F.col("doc_id"))).alias("anchor_id"), F.array_sort(F.collect_list(F.when(F.col(role) != anchor, F.col("doc_id")))).alias("versions"), F.count("*").alias("size")
    )


def levenshtein(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similarity(a: list[str], b: list[str]) -> float:
    """One less the normalised edit distance; where three or more words are shared, their F1 if higher."""
    a, b = [x.lower() for x in a], [x.lower() for x in b]
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    out = 1 - min(levenshtein(a, b) / longest, 1)
    wa, wb = (Counter(x for x in s if any(c.isalnum() for c in x)) for s in (a, b))
    shared = sum((wa & wb).values())
    return max(out, 2 * shared / (sum(wa.values()) + sum(wb.values()))) if shared >= 3 else out


def align_sentences(left: list[list[str]], right: list[list[str]]) -> list[tuple[int | None, int | None, float]] | None:
    """Pairs and gaps of least cost, in order; None beyond the cell budget."""
    n, m = len(left), len(right)
    if n * m > CELLS:
        return None
    sim = [[similarity(a, b) for b in right] for a in left]
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        cost[i][0] = i * GAP
    for j in range(1, m + 1):
        cost[0][j] = j * GAP
    pair = lambda i, j: 1 - sim[i][j] if sim[i][j] >= MIN_SIMILARITY else 2 * GAP + 1e-6
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + pair(i - 1, j - 1), cost[i - 1][j] + GAP, cost[i][j - 1] + GAP)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + pair(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j, sim[i][j]))
        elif i and cost[i][j] == cost[i - 1][j] + GAP:
            i -= 1
            out.append((i, None, 0.0))
        else:
            j -= 1
            out.append((None, j, 0.0))
    return out[::-1]


def sentences(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        out[-1].append(w)
        if w in SENTENCE_ENDS:
            out.append([])
    return [s for s in out if s]


def versions(turns: DataFrame, key: str, anchor: str) -> DataFrame:
    """pair_id, version_id, left and right: the words of a group's anchor with those of each of its other turns.

    The anchor is the first turn of the role ``anchor``, as in ``groups``, or the first turn of a group without one.
    """
    t = turns.select(F.col(key).alias("pair_id"), F.col("turn").cast("long").alias("version_id"), "role", tokens_of(F.col("text")).alias("right"))
    first = F.min(F.struct((F.col("role") != anchor).alias("other"), F.col("version_id").alias("anchor_id"), F.col("right").alias("left")))
    anchors = t.groupBy("pair_id").agg(first.alias("a")).select("pair_id", "a.anchor_id", "a.left")
    return t.join(anchors, "pair_id").where("version_id <> anchor_id").select("pair_id", "version_id", "left", "right")


def align(pairs: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Sentence pairs of (pair_id, left array<string>, right array<string>); a pair over the budget has one row not_applicable.

    ``keys`` are the columns of long that name a pair.
    """

    def run(batches):
        for df in batches:
            rows = []
            for *key, a, b in zip(*(df[k] for k in keys), df["left"], df["right"], strict=True):
                found = align_sentences(sentences(list(a)), sentences(list(b)))
                rows += [(*key, None, None, None, "not_applicable")] if found is None else [(*key, i, j, s, "pair" if i is not None and j is not None else "gap") for i, j, s in found]
            out = pd.DataFrame(rows, columns=[*keys, "left_sent", "right_sent", "similarity", "kind"])
            yield out.astype({"left_sent": "Int32", "right_sent": "Int32"})

    return pairs.select(*keys, "left", "right").mapInPandas(run, ", ".join(f"{k} long" for k in keys) + ", left_sent int, right_sent int, similarity double, kind string")


def parallel_lines(corpus: Corpus, hits: DataFrame, key: str) -> DataFrame:
    """For the sentence of each hit, the most similar sentence of every other document of its pair group.

    Only sentences of groups with hits are gathered; ties go to the earlier sentence.
    """
    groups_ = corpus.docs.select("doc_id", key)
    own = hits.select("doc_id", "sent_id").distinct().join(groups_, "doc_id")
    wanted = groups_.join(own.select(key).distinct(), key, "left_semi")
    sents = corpus.tokens.join(wanted.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "word"))).alias("t")).select("doc_id", "sent_id", F.col("t.word").alias("w"))
    left = own.join(sents, ["doc_id", "sent_id"])
    right = sents.join(wanted, "doc_id").select(key, F.col("doc_id").alias("other_id"), F.col("sent_id").alias("other_sent"), F.col("w").alias("other_w"))
    met = left.join(right, key).where(F.col("doc_id") != F.col("other_id"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    scored = met.withColumn("similarity", alike("w", "other_w"))
    best = scored.groupBy("doc_id", "sent_id", "other_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("other_sent"), F.col("other_w"))).alias("b"), F.first("w").alias("w"))
    return best.select("doc_id", "sent_id", F.array_join("w", " ").alias("sentence"), "other_id", "b.other_sent", F.array_join("b.other_w", " ").alias("other_sentence"), (-F.col("b.s")).alias("similarity"))


# -- agreement -------------------------------------------------------------------------


def agreement(annotations: DataFrame) -> DataFrame:
    """One row of (row_id, coder, category): n_coders, percent, kappa and its kind."""
    a = annotations.select("row_id", "coder", "category").distinct()
    per = a.groupBy("row_id", "category").agg(F.count("*").alias("n"))
    rows = per.groupBy("row_id").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).where("k > 1")
    pooled = rows.agg((F.sum(F.col("nn") - F.col("k")).cast("double") / F.sum(F.col("k") * (F.col("k") - 1))).alias("percent"), F.avg((F.col("nn") - F.col("k")).cast("double") / (F.col("k") * (F.col("k") - 1))).alias("p_mean"))
    coders = a.agg(F.count_distinct("coder").alias("n_coders"))
    used = per.join(rows.select("row_id"), "row_id", "left_semi").groupBy("category").agg(F.sum("n").cast("double").alias("n"))
    share = used.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe_fleiss"))
    whole = a.join(rows.select("row_id"), "row_id", "left_semi")
    margins = whole.groupBy("coder", "category").agg(F.count("*").cast("double").alias("n"))
    product = margins.groupBy("category").agg(F.product("n").alias("p"), F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") == 2, F.col("p"))), F.lit(0.0)).alias("pp"))
    both = product.crossJoin(rows.agg(F.count("*").cast("double").alias("n_rows"))).select((F.col("pp") / (F.col("n_rows") * F.col("n_rows"))).alias("pe_cohen"))
    all_ = pooled.crossJoin(coders).crossJoin(share).crossJoin(both)
    two = F.col("n_coders") == 2
    po, pe = F.when(two, F.col("percent")).otherwise(F.col("p_mean")), F.when(two, F.col("pe_cohen")).otherwise(F.col("pe_fleiss"))
    kappa = F.when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / (1.0 - pe))
    return all_.select("n_coders", "percent", F.when(F.abs(kappa) < 1e-9, 0.0).otherwise(kappa).alias("kappa"), F.when(two, "cohen").otherwise("fleiss").alias("kind"))


def category_agreement(annotations: DataFrame) -> DataFrame:
    """For each category, over pairs of coders on a row: both over at least one.

    From counts: n coders of k chose it, so n(n-1)/2 pairs agree and n(k-n) disagree.
    """
    a = annotations.select("row_id", "coder", "category").distinct()
    k = a.groupBy("row_id").agg(F.count_distinct("coder").alias("k"))
    n = a.groupBy("row_id", "category").agg(F.count("*").alias("n")).join(k, "row_id")
    agree, apart = F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum(F.col("n") * (F.col("k") - F.col("n")))
    return n.groupBy("category").agg(agree.cast("long").alias("both_pairs"), (agree + apart).cast("long").alias("any_pairs"), F.when(agree + apart > 0, agree / (agree + apart)).alias("agreement"))

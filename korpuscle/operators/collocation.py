"""Windowed co-occurrence: collocates, contrasts, co-occurrence hits, context keyness, networks.

The window of a node is a set union. A token is in it if a hit starts up to w places after it
or ends up to w places before it, in the same unit: two window frames over the token table
and no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures, numeric
from . import counting
from .components import cut
from .corpus import Corpus, unit


def mark_windows(corpus: Corpus, node: Column | DataFrame, window: int, within: str = "s") -> DataFrame:
    """The tokens with in_w, true inside W(u), and is_start, true where a hit starts.

    ``node`` is a token condition, or a DataFrame of hits or of their marks.
    """
    if not 1 <= window <= 50:
        raise ValueError("a window goes from 1 to 50")
    if isinstance(node, Column):
        rows = corpus.tokens.withColumn("is_start", F.coalesce(node, F.lit(False))).withColumn("is_last", F.col("is_start"))
    else:
        marks = node if "is_last" in node.columns else marks_of(node)
        rows = corpus.tokens.join(marks, ["doc_id", "tok_idx"], "left").na.fill(False, ["is_start", "is_last"])
    w = unit(within)
    before = F.max("is_start").over(w.rowsBetween(1, window))
    after = F.max("is_last").over(w.rowsBetween(-window, -1))
    return rows.withColumn("in_w", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def marks_of(hits: DataFrame) -> DataFrame:
    """The first and last tokens of hits: doc_id, tok_idx, is_start, is_last."""
    ends = F.explode(F.array(F.struct(F.col("start_idx").alias("i"), F.lit(True).alias("s"), (F.col("end_idx") - 1 == F.col("start_idx")).alias("e")), F.struct((F.col("end_idx") - 1).alias("i"), F.lit(False).alias("s"), F.lit(True).alias("e")))).alias("x")
    return hits.select("doc_id", ends).groupBy("doc_id", F.col("x.i").alias("tok_idx")).agg(F.max("x.s").alias("is_start"), F.max("x.e").alias("is_last"))


def node_condition(word: str) -> Column:
    return F.col("word_lc") == word.lower()


def adaptive_floor(requested: int | None, fu: Column) -> Column:
    if requested is not None:
        return F.lit(max(2, requested))
    return F.when(fu >= 50, F.lit(5)).otherwise(F.greatest(F.lit(2), F.least(F.floor(fu / 10).cast("int"), F.lit(5))))


def by_document_only(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows, written, their joins on (doc_id, tok_idx) taken where documents lie: tokens dealt by doc_id alone are not moved."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(rows)
    finally:
        spark.conf.set(name, was)


def counts(corpus: Corpus, node: Column | DataFrame, window: int, within: str, attr: str = "word", weighted: bool = False) -> DataFrame:
    """One row a collocate: o11, c1, r1, n, fu; everything from one pass over the marked tokens.

    For a DataFrame of hits, its marks are written once and only documents with a mark get windows; c1 is counted over all.
    """
    key = corpus.column(attr)
    every, hits = corpus.tokens, isinstance(node, DataFrame)
    if hits:
        node = cut(marks_of(node))
        corpus = corpus.scope(node)
    marked = mark_windows(corpus, node, window, within)
    in_w = F.col("in_w").cast("long")
    if weighted:  # overlaps count as often as they cover
        w = unit(within)
        in_w = (F.coalesce(F.sum(F.col("is_start").cast("long")).over(w.rowsBetween(1, window)), F.lit(0)) + F.coalesce(F.sum(F.col("is_last").cast("long")).over(w.rowsBetween(-window, -1)), F.lit(0))).cast("long")
        marked = marked.withColumn("weight", in_w)
        in_w = F.col("weight")
    if hits:
        marked = marked.where("in_w or is_start")
    per = marked.groupBy(F.col(key).alias("collocate")).agg(F.sum(in_w).alias("o11"), F.count("*").alias("c1"), F.count_if("is_start").alias("starts"))
    if hits:
        near, none = by_document_only(every.sparkSession, per), F.lit(0).cast("long")
        c1 = every.groupBy(F.col(key).alias("collocate")).agg(none.alias("o11"), F.count("*").alias("c1"), none.alias("starts"))
        sums = [F.sum(x).alias(x) for x in ("o11", "c1", "starts")]
        per = c1.union(near.withColumn("c1", none)).groupBy("collocate").agg(*sums)
        met = F.col("o11") > 0  # words that are no collocates are one row
        per = cut(per.groupBy(met.alias("met"), F.when(met, F.col("collocate")).alias("collocate")).agg(*sums)).drop("met")
    # totals of a vocabulary-sized table, joined as one row
    totals = per.agg(F.sum("o11").alias("r1"), F.sum("c1").alias("n"), F.sum("starts").alias("fu"))
    return per.where("o11 > 0").drop("starts").crossJoin(F.broadcast(totals))


def collocates(
    corpus: Corpus, node: str | Column | DataFrame, window: int = 5, within: str = "s", attr: str = "word", min_freq: int | None = None, words_only: bool = True, with_lrc: bool = False, weighted: bool = False
) -> DataFrame:
    """The collocates of a node with every measure, unrounded."""
    drop_self = None
    if isinstance(node, str):
        drop_self, node = node.lower(), node_condition(node)
    rows = counts(corpus, node, window, within, attr, weighted)
    rows = rows.where(F.col("o11") >= adaptive_floor(min_freq, F.col("fu")))
    if words_only:
        from ..functions.text import is_word

        rows = rows.where(is_word(F.col("collocate")))
    if drop_self is not None:
        rows = rows.where(F.lower("collocate") != drop_self)
    out = rows.withColumns(measures.association(*(F.col(c) for c in ("o11", "r1", "c1", "n", "fu"))))
    if with_lrc:
        m = out.agg(F.count("*").alias("m"))
        out = out.crossJoin(F.broadcast(m)).withColumn("lrc", numeric.lrc("o11", F.col("c1") - F.col("o11"), "r1", F.col("n") - F.col("r1"), "m"))
    return out


def ranked(rows: DataFrame, by: str = "logdice", limit: int = 50) -> DataFrame:
    """The best rows by a measure, all having been scored; ties by the collocate."""
    return rows.orderBy(F.desc(by), "collocate").limit(limit)


def displayed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, k) for c, k in measures.DISPLAY.items() if c in rows.columns})


def contrast(corpus: Corpus, node: str | Column, target: Column, reference: Column, window: int = 5, within: str = "s", min_freq: int = 5) -> DataFrame:
    """Collocates on two sides, from one pass; ranked by the difference of rates."""
    cond = node_condition(node) if isinstance(node, str) else node
    two = counting.sides(corpus, target, reference)
    marked = mark_windows(two, cond, window, within)
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, c)), F.lit(0))
    in_w = F.col("in_w").cast("long")
    per = marked.groupBy(F.col("word").alias("collocate")).agg(*[side(s, in_w).alias(f"o_{s}") for s in "tr"], *[side(s, F.lit(1)).alias(f"c_{s}") for s in "tr"])
    totals = per.agg(*[F.sum(f"o_{s}").alias(f"r1_{s}") for s in "tr"], *[F.sum(f"c_{s}").alias(f"n_{s}") for s in "tr"])
    rows = per.where(F.greatest("o_t", "o_r") >= min_freq).crossJoin(F.broadcast(totals))
    d = lambda c: F.col(c).cast("double")
    dice = lambda s: F.when(d(f"r1_{s}") + d(f"c_{s}") > 0, 2.0 * d(f"o_{s}") / (d(f"r1_{s}") + d(f"c_{s}"))).otherwise(F.lit(0.0))
    rate = lambda s: measures.over(1e6 * d(f"o_{s}"), d(f"n_{s}"))
    diff = rate("t") - rate("r")
    return rows.select(
        "collocate", F.col("o_t").alias("target_freq"), F.col("o_r").alias("reference_freq"), dice("t").alias("target_score"), dice("r").alias("reference_score"),
        rate("t").alias("target_per_million"), rate("r").alias("reference_per_million"), (dice("t") - dice("r")).alias("diff_score"), diff.alias("diff_per_million"), F.abs(diff).alias("diff_abs"),
        F.log2(measures.over(measures.over(d("o_t") + 0.5, d("n_t")), measures.over(d("o_r") + 0.5, d("n_r")))).alias("log_ratio"), ((F.col("o_t") == 0) != (F.col("o_r") == 0)).alias("one_sided"),
    )


def version_contrast(corpus: Corpus, node: str | Column, role: str, anchor: str, window: int = 5, within: str = "s", min_freq: int = 5) -> DataFrame:
    """contrast() with its sides from pairing: documents whose role is ``anchor`` against all other versions; a null role is on neither side."""
    own = F.col(role) == anchor
    return contrast(corpus, node, own, ~own, window, within, min_freq)


def co_occurrence(corpus: Corpus, node: str, collocates_: list[str], window: int = 5, within: str = "s", attr: str = "word") -> DataFrame:
    """Node hits whose own window holds every collocate: one frame sum for each."""
    w = unit(within)
    c = F.lower(corpus.column(attr))
    marked = corpus.tokens.withColumn("_node", node_condition(node)).withColumns({f"_c{k}": (c == x.lower()).cast("int") for k, x in enumerate(collocates_)})
    near = [F.coalesce(F.sum(f"_c{k}").over(w.rowsBetween(-window, window)), F.lit(0)) - F.col(f"_c{k}") for k in range(len(collocates_))]
    marked = marked.withColumns({f"_n{k}": x for k, x in enumerate(near)})
    test = reduce(Column.__and__, [F.col(f"_n{k}") > 0 for k in range(len(collocates_))], F.col("_node"))
    return marked.where(test).select("doc_id", "sent_id", F.col("tok_idx").alias("start_idx"), (F.col("tok_idx") + 1).alias("end_idx"), F.col("tok_idx").alias("node_idx"))


def context_keyness(corpus: Corpus, node: str | Column | DataFrame, window: int = 5, within: str = "s", min_freq: int = 5, include_node: bool = False) -> DataFrame:
    """Word tokens of W(u) against those of the rest of the corpus."""
    cond = node_condition(node) if isinstance(node, str) else node
    marked = mark_windows(corpus, cond, window, within).where("is_word")
    inside = F.col("in_w") | F.col("is_start") if include_node else F.col("in_w")
    if not include_node:
        marked = marked.where(~F.col("is_start") | F.col("in_w"))
    per = marked.groupBy("word_lc").agg(F.count_if(inside).alias("a"), F.count_if(~inside).alias("c"))
    totals = per.agg(F.sum("a").alias("nt"), F.sum("c").alias("nr"))
    rows = per.where(F.col("a") + F.col("c") >= min_freq).crossJoin(F.broadcast(totals))
    return rows.withColumns(measures.keyness(*(F.col(x) for x in ("a", "c", "nt", "nr"))))


def network(corpus: Corpus, node: str, depth: int = 2, nodes: int = 40, window: int = 5, within: str = "s", by: str = "logdice") -> DataFrame:
    """Ego network (source, target, weight, depth): undirected edges, at most ``nodes`` (120) nodes.

    The hubs of the second ring are counted in one job, their hits exploded, not one job each.
    """
    nodes = min(nodes, 120)
    first = ranked(collocates(corpus, node, window, within), by, nodes - 1).select(F.lower("collocate").alias("target"), F.col(by).alias("weight"))
    ego = [(node.lower(), r["target"], float(r["weight"]), 1) for r in first.collect()]  # at most 120 rows
    spark = corpus.tokens.sparkSession
    ddl = "source string, target string, weight double, depth int"
    if depth < 2 or not ego:
        return spark.createDataFrame(_unique(ego), ddl)
    hubs = [t for _, t, _, _ in ego][: max(5, (nodes - 1) // 2)]
    w = unit(within)
    words = corpus.tokens.select("doc_id", "sent_id", "tok_idx", "word_lc", "is_word")
    around = lambda k: F.lag("word_lc", -k).over(w) if k < 0 else F.lead("word_lc", k).over(w)
    near = words.withColumn("near", F.array(*[around(k) for k in range(-window, window + 1) if k]))
    met = near.select("word_lc", "is_word", F.explode(F.array_distinct(F.array_intersect("near", F.array(*map(F.lit, hubs))))).alias("hub"))
    pair = met.groupBy("hub", "word_lc").agg(F.count("*").alias("o11"), F.first("is_word").alias("is_word"))
    r1 = pair.groupBy("hub").agg(F.sum("o11").alias("r1"))
    freq = words.groupBy("word_lc").agg(F.count("*").alias("c1"))
    n = freq.agg(F.sum("c1").alias("n"))
    fu = freq.select(F.col("word_lc").alias("hub"), F.col("c1").alias("fu"))
    known = [node.lower(), *(t for _, t, _, _ in ego)]
    rows = pair.where(F.col("is_word") & (F.col("hub") != F.col("word_lc")) & F.col("word_lc").isin(known)).join(F.broadcast(r1), "hub").join(freq, "word_lc").join(fu, "hub").crossJoin(F.broadcast(n))
    rows = rows.where(F.col("o11") >= adaptive_floor(None, F.col("fu")))
    scored = rows.select("hub", "word_lc", measures.association(*(F.col(c) for c in ("o11", "r1", "c1", "n", "fu")))[by].alias("weight"))
    ring = [(r["hub"], r["word_lc"], float(r["weight"]), 2) for r in scored.orderBy("hub", F.desc("weight"), "word_lc").collect()]  # <= 120 x 120
    return spark.createDataFrame(_unique(ego + ring), ddl)


def _unique(edges: list[tuple[str, str, float, int]]) -> list[tuple[str, str, float, int]]:
    """Undirected: of two edges of a pair the one found first stays."""
    seen, out = set(), []
    for a, b, weight, depth in edges:
        if frozenset((a, b)) not in seen and a != b:
            seen.add(frozenset((a, b)))
            out.append((a, b, weight, depth))
    return out

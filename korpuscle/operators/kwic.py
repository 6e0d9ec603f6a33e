"""Concordances: context, spacing, sorting, sampling, row algebra."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import formula_guard, mask_pii, sort_fold
from .corpus import Corpus
from .running import running_start

MAX_LINES, MAX_SAMPLE = 5000, 10_000


def lines(corpus: Corpus, hits: DataFrame, ctx: int = 5, attr: str = "word") -> DataFrame:
    """left, node, right of each hit, context clipped at the document.

    Only documents with hits are gathered to token arrays, and a hit slices its array.
    """
    key = corpus.column(attr)
    wanted = corpus.tokens.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    arrays = wanted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", F.col(key).alias("w")))).alias("t")).select("doc_id", F.col("t.w").alias("w"))
    return sliced(hits.join(arrays, "doc_id"), ctx).drop("w")


def sliced(df: DataFrame, ctx: int) -> DataFrame:
    s, e = F.col("start_idx"), F.col("end_idx")
    first = F.greatest(F.lit(0), s - ctx)
    return df.withColumns({
        "left": F.array_join(F.slice("w", first + 1, s - first), " "), "node": F.array_join(F.slice("w", s + 1, e - s), " "),
        "right": F.array_join(F.slice("w", e + 1, F.lit(ctx)), " "), "match_start": s, "match_end": e,
    })


def spaced(words: Column, ws_after: Column) -> Column:
    """Words joined as in the source: a blank only where one followed."""
    pairs = F.arrays_zip(words.alias("w"), ws_after.alias("s"))
    return F.rtrim(F.aggregate(pairs, F.lit(""), lambda acc, x: F.concat(acc, x["w"], F.when(x["s"], F.lit(" ")).otherwise(F.lit("")))))


_SORT = re.compile(r"^(?:([123])(L|R)|node|meta:(\w+))$", re.I)


def sort_keys(spec: list[str]) -> list[Column]:
    out = []
    for s in spec:
        m = _SORT.match(s)
        if not m:
            raise ValueError(f"unknown sort key {s!r}; use 1L to 3L, node, 1R to 3R or meta:field")
        if m[1]:
            k, side = int(m[1]), m[2].upper()
            words = F.split(F.col("left" if side == "L" else "right"), " ")
            out.append(sort_fold(F.coalesce(F.try_element_at(words, F.lit(-k if side == "L" else k)), F.lit(""))))
        else:
            out.append(sort_fold(F.col(m[3]).cast("string") if m[3] else F.col("node")))
    return out


def ordered(rows: DataFrame, spec: list[str], desc: bool = False) -> DataFrame:
    """Sorted lines; ties by position, and descending turns both."""
    keys = [*sort_keys(spec), F.col("doc_id"), F.col("start_idx")]
    return rows.orderBy(*[k.desc() if desc else k.asc() for k in keys])


def page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return rows.orderBy("doc_id", "start_idx").offset(offset).limit(min(limit, MAX_LINES))


def sample(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """A uniform sample without replacement in corpus order, repeatable by its seed.

    Lines are ranked by a hash of seed and position, so the draw is distributed and needs no row numbers.
    """
    if not 1 <= size <= MAX_SAMPLE:
        raise ValueError(f"a sample has 1 to {MAX_SAMPLE} lines")
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id", "start_idx"), "doc_id", "start_idx").limit(size).orderBy("doc_id", "start_idx")


def sample_indices(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """The sample whose line numbers numpy's generator draws for the seed."""
    per = rows.groupBy("doc_id").agg(F.count("*").alias("_n"))
    n = per.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    chosen = np.sort(np.random.default_rng(seed).choice(n, min(size, n), replace=False)).tolist() if n else []
    picked = rows.sparkSession.createDataFrame([(int(i),) for i in chosen], "_i long")
    starts = running_start(per, "_n", "_start").select("doc_id", "_start")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_idx")) - 1
    numbered = rows.withColumn("_in", place).join(starts, "doc_id").withColumn("_i", (F.col("_start") + F.col("_in")).cast("long")).drop("_start", "_in")
    return numbered.join(F.broadcast(picked), "_i").drop("_i").orderBy("doc_id", "start_idx")


class Concordance:
    """Lines with a tree of views derived from them."""

    ALGORITHMS = ("filter_contains", "limit", "sort", "dedup", "sample")

    def __init__(self, rows: DataFrame, steps: tuple = ()):
        self.rows, self.steps = rows, steps

    def apply(self, name: str, **args) -> Concordance:
        if name not in self.ALGORITHMS:
            raise ValueError(f"unknown step {name!r}; there are {', '.join(self.ALGORITHMS)}")
        r = self.rows
        if name == "filter_contains":
            out = r.where(F.lower(args.get("column", "node")).contains(args["text"].lower()))
        elif name == "limit":
            out = page(r, 0, args["n"])
        elif name == "sort":
            out = ordered(r, args["by"], args.get("desc", False))
        elif name == "dedup":
            out = r.dropDuplicates(args.get("columns", ["left", "node", "right"]))
        else:
            out = sample(r, args["size"], args["seed"])
        return Concordance(out, (*self.steps, (name, tuple(sorted(args.items(), key=str)))))


def export(rows: DataFrame, mask: bool = False) -> DataFrame:
    """Text cells ready for a table file: formula guard, and masked personal data if asked."""
    out = rows
    for c, t in rows.dtypes:
        if t == "string":
            cell = mask_pii(F.col(c)) if mask else F.col(c)
            out = out.withColumn(c, formula_guard(cell))
    return out


def source_lines(corpus: Corpus, hits: DataFrame, ctx: int = 5) -> DataFrame:
    """As lines(), spaced as in the source; the corpus must have ws_after."""
    corpus.tokens["ws_after"]
    wanted = corpus.tokens.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    arrays = wanted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", F.col("word").alias("w"), F.col("ws_after").alias("s")))).alias("t"))
    rows = hits.join(arrays, "doc_id")
    s, e = F.col("start_idx"), F.col("end_idx")
    first = F.greatest(F.lit(0), s - ctx)
    part = lambda a, n: spaced(F.slice("t.w", a + 1, n), F.slice("t.s", a + 1, n))
    return rows.withColumns({"left": part(first, s - first), "node": part(s, e - s), "right": part(e, F.lit(ctx))}).drop("t")


def document_list(corpus: Corpus, offset: int = 0, limit: int = 100) -> DataFrame:
    return corpus.docs.orderBy("doc_id").offset(offset).limit(min(limit, MAX_LINES))


def snippet(corpus: Corpus, hits: DataFrame, ctx: int = 12) -> DataFrame:
    """One line for each document with hits, that of its first."""
    first = hits.groupBy("doc_id").agg(F.min(F.struct("start_idx", "end_idx")).alias("h")).select("doc_id", "h.start_idx", "h.end_idx")
    rows = lines(corpus, first, ctx)
    return rows.select("doc_id", F.concat_ws(" ", "left", "node", "right").alias("snippet"), F.col("start_idx").alias("first_idx"))


def document_text(corpus: Corpus, doc_id: int) -> DataFrame:
    one = corpus.tokens.where(F.col("doc_id") == doc_id)
    words = F.array_sort(F.collect_list(F.struct("tok_idx", "word")))
    return one.groupBy("doc_id").agg(words.alias("t")).select("doc_id", F.array_join("t.word", " ").alias("text"))

"""Dispersion over documents, trends over periods, lexical diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, numeric
from ..functions.measures import over
from .corpus import Corpus
from .running import running_start


def profile(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """doc_id, o (hits) and s (tokens) of every document, those without hits too."""
    per = hits.groupBy("doc_id").agg(F.count("*").alias("o"))
    return corpus.docs.select("doc_id", F.col("n_tokens").alias("s")).join(per, "doc_id", "left").na.fill(0, ["o"])


def family(p: DataFrame) -> DataFrame:
    """One row: hits, n_docs, range, dp, dpnorm, vc, juilland_d, carroll_d2, dp_max."""
    totals = p.agg(F.sum("o").alias("f"), F.sum("s").alias("n"))
    d = p.crossJoin(F.broadcast(totals)).select(
        F.col("o").cast("double").alias("o"), F.col("s").cast("double").alias("s"), F.col("f").cast("double").alias("f"), F.col("n").cast("double").alias("n"),
    )
    v = F.when(F.col("s") > 0, F.col("o") / F.col("s")).otherwise(F.lit(0.0))
    share = over(F.col("o"), F.col("f"))
    sums = d.agg(
        F.first("f").cast("long").alias("hits"), F.count("*").alias("n_docs"), F.count_if(F.col("o") > 0).alias("range"),
        (0.5 * F.sum(F.abs(share - over(F.col("s"), F.col("n"))))).alias("dp"), (1.0 - F.min(over(F.col("s"), F.col("n")))).alias("dp_max"),
        F.avg(v).alias("mean"), F.avg(v * v).alias("square"), (-F.sum(F.when(F.col("o") > 0, share * F.log(share)))).alias("entropy"),
    )
    none = (F.col("hits") == 0) | (F.col("n_docs") <= 1)
    unless = lambda c: F.when(none, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    sums = sums.withColumn("vc", unless(over(F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))), F.col("mean"))))
    clip01 = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return sums.select(
        "hits", "n_docs", "range", unless(F.col("dp")).alias("dp"), unless(over(F.col("dp"), F.col("dp_max"))).alias("dpnorm"), "vc",
        unless(clip01(1.0 - over(F.col("vc"), F.sqrt(F.col("n_docs").cast("double") - 1.0)))).alias("juilland_d"), unless(clip01(over(F.col("entropy"), F.log(F.col("n_docs").cast("double"))))).alias("carroll_d2"), "dp_max",
    )


def references(p: DataFrame) -> DataFrame:
    """One row: dp_min by largest remainders, dp_expected under chance, dp_max.

    Documents of one size have one share and one remainder, so everything is done on the
    distinct sizes and their counts.
    """
    sizes = p.groupBy("s").agg(F.count("*").alias("k"), F.sum("o").alias("o"))
    totals = sizes.agg(F.sum("o").alias("f"), F.sum(F.col("s") * F.col("k")).alias("n"))
    d = sizes.crossJoin(F.broadcast(totals)).withColumn("share", over(F.col("s"), F.col("n")))
    d = d.withColumn("ideal", F.col("f") * F.col("share")).withColumn("base", F.floor("ideal"))
    left = d.agg((F.first("f") - F.sum(F.col("base") * F.col("k"))).alias("left"))
    before = F.sum("k").over(Window.orderBy(F.desc(F.col("ideal") - F.col("base")), "s").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("before", F.coalesce(before, F.lit(0))).crossJoin(F.broadcast(left))
    d = d.withColumn("up", F.greatest(F.lit(0), F.least(F.col("k"), F.col("left") - F.col("before"))))
    off = lambda o: F.abs(over(o, F.col("f")) - F.col("share"))
    apart = F.col("up") * off(F.col("base") + 1) + (F.col("k") - F.col("up")) * off(F.col("base"))
    d = d.withColumn("apart", apart).withColumn("mad", numeric.expected_deviation("f", "share") * F.col("k"))
    f = F.first("f").cast("double")
    return d.agg((0.5 * F.sum("apart")).alias("dp_min"), over(0.5 * F.sum("mad"), f).alias("dp_expected"), (1.0 - F.min("share")).alias("dp_max"))


def label(hits: Column, dp: Column, low: Column, expected: Column, high: Column) -> Column:
    return (
        F.when(hits == 0, "not_found").when(high - low < 0.05, "too_few_hits").when(dp <= 0.75 * expected, "even").when(dp <= expected, "fairly_even")
        .when(over(dp - expected, high - expected) >= 0.5, "clustered").otherwise("fairly_clustered")
    )


def dispersion(corpus: Corpus, hits: DataFrame) -> DataFrame:
    p = profile(corpus, hits)
    out = family(p).crossJoin(references(p).drop("dp_max"))
    return out.withColumn("label", label(*(F.col(c) for c in ("hits", "dp", "dp_min", "dp_expected", "dp_max"))))


def offsets(corpus: Corpus, hits: DataFrame, bins: int = 20) -> DataFrame:
    """Hits by document and tenth or so of its length."""
    rows = hits.join(corpus.docs.select("doc_id", "n_tokens"), "doc_id")
    return rows.groupBy("doc_id", F.floor(F.col("start_idx").cast("double") * bins / F.col("n_tokens")).cast("int").alias("bin")).agg(F.count("*").alias("n_hits"))


# -- trends ----------------------------------------------------------------------------


def period(value: Column, granularity: str = "year") -> Column:
    """The leading YYYY or YYYY-MM of a date string; else undated."""
    pattern = r"^\s*(\d{4})(?:[-/.](\d{1,2}))?"
    year, month = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)
    text = year if granularity == "year" else F.when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise(year)
    return F.when(F.coalesce(year, F.lit("")) == "", F.lit("undated")).otherwise(text)


def trend(docs: DataFrame, hits: DataFrame, field: str, granularity: str = "year", periods: int = 500) -> DataFrame:
    """Hits per million word tokens of each period with Wilson bounds. docs: doc_id, n_words, field."""
    per = hits.groupBy("doc_id").agg(F.count("*").alias("h"))
    rows = docs.select("doc_id", "n_words", period(F.col(field).cast("string"), granularity).alias("period")).join(per, "doc_id", "left")
    out = rows.groupBy("period").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("n_hits"), F.sum("n_words").alias("n_words")).orderBy("period").limit(periods)
    low, high = measures.wilson(F.col("n_hits"), F.col("n_words"))
    return out.select("period", "n_hits", "n_words", over(1e6 * F.col("n_hits").cast("double"), F.col("n_words")).alias("per_million"), (1e6 * low).alias("low"), (1e6 * high).alias("high"))


# -- lexical diversity -----------------------------------------------------------------


#: Windows in a stretch of mattr().
STRETCH = 16


def word_stream(corpus: Corpus, by: str | None = None) -> DataFrame:
    """Word tokens with their place i in the joined stream (of each side, with ``by``).

    Places are a running sum over documents plus a place within the document; no window
    runs over all tokens.
    """
    side = [by] if by else []
    starts = running_start(corpus.docs.select("doc_id", *side, "n_words"), "n_words", "_start", side).select("doc_id", "_start")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx")) - 1
    words = corpus.tokens.where("is_word").select("doc_id", *side, "tok_idx", "word", place.alias("_in"))
    return words.join(starts, "doc_id").select(*side, "word", (F.col("_start") + F.col("_in")).alias("i"))


def type_token(corpus: Corpus, by: str | None = None) -> DataFrame:
    side = [by] if by else []
    per = corpus.tokens.where("is_word").groupBy(*side, "word").agg(F.count("*").alias("c"))
    n, v = F.sum("c"), F.count("*")
    return per.groupBy(*side).agg(v.alias("types"), n.alias("words"), (v.cast("double") / n).alias("ttr"), (v.cast("double") / F.sqrt(n.cast("double"))).alias("guiraud"))


def sttr(corpus: Corpus, window: int = 1000) -> DataFrame:
    """Mean type-token ratio of full consecutive windows."""
    per = word_stream(corpus).groupBy(F.floor(F.col("i") / window).alias("w"), "word").agg(F.count("*").alias("c"))
    windows = per.groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("v")).where(F.col("n") == window)
    return windows.agg(F.count("*").alias("windows"), over(F.sum("v"), F.count("*") * window).alias("sttr"))


def mattr(corpus: Corpus, window: int = 500) -> DataFrame:
    """Mean type-token ratio of all sliding windows, in closed form.

    A word at i is the first of its kind in the windows that hold it and not its last place before.
    """
    stream = word_stream(corpus)
    n = stream.agg(F.count("*").alias("n"))
    # Only a place less than a window before matters, so places are parted in stretches, of which each also
    # gets the last window of the one before; no word, however common, meets in one task.
    size = STRETCH * window
    own = F.floor(F.col("i") / size)
    parts = F.when(F.col("i") % size >= size - window, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = stream.select("word", "i", F.explode(parts).alias("part"))
    last = F.coalesce(F.lag("i").over(Window.partitionBy("word", "part").orderBy("i")), F.lit(-1))
    rows = dealt.withColumn("prev", last).where(F.col("part") == own).crossJoin(F.broadcast(n))
    first_start = F.greatest(F.col("prev") + 1, F.col("i") - (window - 1), F.lit(0))
    held = F.greatest(F.lit(0), F.least(F.col("i"), F.col("n") - window) - first_start + 1)
    out = rows.agg(F.sum(held).alias("s"), F.max("n").alias("n"))
    return out.select(F.when(F.col("n") >= window, F.col("s").cast("double") / ((F.col("n") - window + 1).cast("double") * window)).alias("mattr"))


def per_side(corpus: Corpus, by: str) -> DataFrame:
    """Type-token figures of each side, with a warning where the smaller side is below 80 % of the larger."""
    out = type_token(corpus, by)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("uneven", F.min("words").over(every) < 0.8 * F.max("words").over(every))

"""Vector operators: exact nearest neighbours, centroids, similarity matrices, clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, cut
from .corpus import Corpus
from .running import running_start

#: Cosine of a tie and mean cohesion of a cluster, for the first and the second pass; fewest vectors of a cluster in the first.
LEVELS, LEAST = ((0.60, 0.58), (0.52, 0.50)), 5
#: Vectors in a block, and blocks in a partition of either side of the comparison.
BLOCK, LEFT, RIGHT = 1024, 8, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, least: float | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The k most similar rows, exactly; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(id_col, cosine(F.col(col), q).alias("similarity"))
    if least is not None:
        out = out.where(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), id_col).limit(k)


def similar_words(word_vectors: DataFrame, lexicon: DataFrame, word: str, k: int = 20, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Alphabetic words of the corpus at a cosine of 0.55 or more, with their frequencies."""
    q = word_vectors.where(F.col("word") == word).select("vector").first()
    if q is None:
        raise ValueError(f"no vector for {word!r}")
    k = min(k, 2000)
    known = word_vectors.join(lexicon.select(F.col("value").alias("word"), "freq"), "word").where(F.col("word").rlike(r"^\p{L}+$") & (F.col("word") != word))
    if stopwords:
        known = known.where(~F.col("word").isin(*stopwords))
    scored = known.select("word", "freq", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in q["vector"]])).alias("similarity"))
    return scored.where(F.col("similarity") >= 0.55).orderBy(F.desc("similarity"), "word").limit(k)


def expand_similar(query: str, similar) -> str:
    """``sim("w")`` and ``[sim="w"&k=n]`` as a set of words; similar(word, k) lists them."""
    import re

    def clause(word: str, k: int) -> str:
        return "[word in {" + ", ".join(f'"{w}"' for w in [word, *similar(word, min(k, 2000))]) + "}]"

    query = re.sub(r'\[\s*sim\s*=\s*"([^"]+)"\s*(?:&\s*k\s*=\s*(\d+)\s*)?\]', lambda m: clause(m[1], int(m[2] or 20)), query)
    return re.sub(r'sim\(\s*"([^"]+)"\s*\)', lambda m: clause(m[1], 20), query)


def centroids(vectors: DataFrame, by: str = "label", col: str = "embedding") -> DataFrame:
    """Mean vector of each group, by element; partial sums before the shuffle."""
    parts = vectors.select(by, F.posexplode(col).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    sizes = vectors.groupBy(by).agg(F.count("*").alias("n"))
    rows = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.join(sizes, by).select(by, "n", F.col("v.x").alias("centroid"))


def similarity_matrix(groups: DataFrame, by: str = "label", col: str = "centroid") -> DataFrame:
    """Cosines of all pairs of a few groups, one in each direction kept."""
    a, b = groups.select(F.col(by).alias("a"), F.col(col).alias("va")), groups.select(F.col(by).alias("b"), F.col(col).alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))


def cluster(x: np.ndarray, min_size: int = LEAST) -> np.ndarray:
    """Labels of a few vectors; -1 for none.

    Each vector is tied to its three nearest where either side counts the other among its
    own, at a cosine of 0.60, then 0.52; connected parts of mean cohesion 0.58, then 0.50, are clusters
    if they have ``min_size`` vectors, then one less, but two at least.
    """
    n = len(x)
    out = np.full(n, -1)
    if n < 2:
        return out
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 12)  # copies of a vector tie
    np.fill_diagonal(sims, -1)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    near = np.zeros((n, n), bool)
    near[np.arange(n)[:, None], top] = True
    near |= near.T
    next_label = 0
    for (least, cohesion), fewest in zip(LEVELS, fewest_of(min_size), strict=True):
        free = out < 0
        tie = near & (sims >= least) & free[:, None] & free[None, :]
        seen = ~free
        for i in range(n):
            if seen[i]:
                continue
            part, todo = [], [i]
            seen[i] = True
            while todo:
                j = todo.pop()
                part.append(j)
                for k in np.flatnonzero(tie[j] & ~seen):
                    seen[k] = True
                    todo.append(int(k))
            if len(part) >= fewest:
                inner = sims[np.ix_(part, part)]
                if (inner.sum() + len(part)) / (len(part) * (len(part) - 1)) >= cohesion:
                    out[part] = next_label
                    next_label += 1
    return out


def fewest_of(min_size: int) -> tuple[int, int]:
    """The fewest vectors of a cluster in either pass."""
    return max(2, min_size), max(2, min_size - 1)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", limit: int = 5000, min_size: int = LEAST) -> DataFrame:
    """Clusters of a small selection of vectors; more than ``limit`` rows are an error."""
    rows = vectors.select(id_col, col).orderBy(id_col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"clustering takes at most {limit} vectors")
    labels = cluster(np.array([r[col] for r in rows], float), min_size) if rows else []
    return vectors.sparkSession.createDataFrame([(r[id_col], int(k)) for r, k in zip(rows, labels, strict=True)], f"{id_col} long, cluster int")


_BLOCK = pa.schema([("block", pa.int64()), ("ords", pa.binary()), ("rows", pa.binary()), ("units", pa.binary())])
_TIE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ord", pa.int64()), ("similarity", pa.float64())])


def _packed(group: pa.Table) -> pa.Table:
    """One row for the vectors of a block, in the order of their ids: ids, rows and unit vectors as bytes."""
    group = group.sort_by([("ord", "ascending"), ("row", "ascending")])
    x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    ords, rows = (group[c].to_numpy().astype("<i8").tobytes() for c in ("ord", "row"))
    return pa.Table.from_pylist([{"block": group["block"][0].as_py(), "ords": ords, "rows": rows, "units": unit.astype("<f8").tobytes()}], schema=_BLOCK)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k greatest of each line, the first of equal ones; sims is spoilt."""
    line, at, top = np.arange(len(sims)), [], []
    for _ in range(min(k, sims.shape[1])):
        at.append(sims.argmax(axis=1))
        top.append(sims[line, at[-1]])
        sims[line, at[-1]] = -2
    return np.stack(at, 1), np.stack(top, 1)


def near_ties(rows: DataFrame, k: int = 3, least: float = LEVELS[-1][0]) -> DataFrame:
    """(a, b, similarity): the k nearest of every row of (row, id, v), exactly, as far as they reach ``least``.

    All pairs are compared, block by block, and each task keeps the k best of a row. Cosines are rounded to
    12 places, so that copies of a vector tie in whatever block they are; ties go by id, then row.
    """
    own = rows.where(F.size("v") > 0).withColumn("ord", F.coalesce("id", F.lit(-(1 << 63))))
    blocks = max(1, -(-own.count() // BLOCK))
    packed = own.select("ord", "row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(_packed, "block long, ords binary, rows binary, units binary")
    packed = cut(packed)
    left = packed.repartition(-(-blocks // LEFT))
    right = packed.repartition(-(-blocks // RIGHT)).select(*[F.col(c).alias("r_" + c) for c in packed.columns])

    def run(batches):
        kept: dict[int, tuple] = {}
        for batch in batches:
            for b, ords, own, units, r_b, r_ords, r_rows, r_units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, r_ords, r_rows = (np.frombuffer(x, "<i8") for x in (own, r_ords, r_rows))
                sims = np.frombuffer(units, "<f8").reshape(len(own), -1) @ np.frombuffer(r_units, "<f8").reshape(len(r_rows), -1).T
                np.round(sims, 12, out=sims)
                if b == r_b:
                    np.fill_diagonal(sims, -2)
                at, top = _best(sims, k)
                new = (top, r_ords[at], r_rows[at])
                if b in kept:
                    new = tuple(np.concatenate(x, axis=1) for x in zip(kept[b][1], new, strict=True))
                order = np.lexsort((new[2], new[1], -new[0]), axis=1)[:, :k]
                kept[b] = (own, tuple(np.take_along_axis(x, order, 1) for x in new))
        for own, (top, ords, others) in kept.values():
            i, j = np.nonzero(top >= least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[i], others[i, j], ords[i, j], top[i, j])], schema=_TIE)

    met = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, "a long, b long, ord long, similarity double")
    best = met.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "ord", "b"))), 1, k).alias("best"))
    conf, size = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    conf.set(size, str(LEFT))  # a row here is a pair of blocks
    try:
        return cut(best.select("a", F.explode("best").alias("t")).select("a", "t.b", (-F.col("t.s")).alias("similarity")))
    finally:
        conf.set(size, before)


def cluster_all(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", min_size: int = LEAST) -> DataFrame:
    """The clusters of ``cluster`` over a whole table: id and label of every row, -1 for none.

    Neighbours are found in blocks, connected parts by alternating stars, and the cohesion of a part from the
    sum of its unit vectors. A null or empty vector has no cluster; equal ids are vectors of their own.
    """
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()))
    near = near_ties(rows)
    unit = rows.withColumn("length", F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-12))).select(F.col("row").alias("node"), "id", F.transform("v", lambda x: x / F.col("length")).alias("u"))
    done, labels = None, 0
    for (least, cohesion), fewest in zip(LEVELS, fewest_of(min_size), strict=True):
        tie = near.where(F.col("similarity") >= least).select("a", "b")
        if done is not None:
            for end in ("a", "b"):
                tie = tie.join(done.select(F.col("node").alias(end)), end, "left_anti")
        parts = cut(connected_components(tie))
        inside = parts.join(unit, "node")
        sums = inside.select("root", F.posexplode("u").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x")).groupBy("root").agg(F.sum(F.col("x") * F.col("x")).alias("all"))
        sizes = inside.groupBy("root").agg(F.count("*").alias("n"), F.sum(dot(F.col("u"), F.col("u"))).alias("same"), F.min("id").alias("id"))
        good = cut(sizes.where(F.col("n") >= fewest).join(sums, "root").where((F.col("all") - F.col("same")) / (F.col("n") * (F.col("n") - 1)) >= cohesion).select("root", "id", F.lit(1).alias("one")))
        named = running_start(good, "one", "before", order="id").select("root", (F.col("before") + labels).cast("int").alias("cluster"))
        labels += good.count()
        found = parts.join(named, "root").select("node", "cluster")
        done = cut(found if done is None else done.union(found))
    out = rows.select(F.col("id").alias(id_col), F.col("row").alias("node")).join(done, "node", "left")
    return out.select(id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_labels(corpus: Corpus, members: DataFrame) -> DataFrame:
    """(cluster, label, size): the commonest folded word of each cluster of (doc_id, cluster), ties by the word; -1 has none."""
    own = members.where("cluster >= 0").select("doc_id", "cluster")
    freq = corpus.tokens.where("is_word").join(own, "doc_id").groupBy("cluster", "word_lc").agg(F.count("*").alias("n"))
    best = freq.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "word_lc")).alias("b"))
    return own.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster", "left").select("cluster", F.coalesce("b.word_lc", F.lit("")).alias("label"), "size")

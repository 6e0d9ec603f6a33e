"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel. Each partition of the labelled rows sums its
share of the normal equations; the sums are added by row of the matrix, and a matrix of fixed
size comes to the driver. Ridge scores of rows that the fit has not seen (two folds take
turns) are counted in a fixed number of bins and calibrated by pooling adjacent violators.
All labelled rows of the learning folds take part.

Defined cases: a null text counts as empty; every row gets a score; labels of one class
give that class's rate, no labels 0.5; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_hash_mod, labelled
from .textstats import RATIOS, document_stats

#: Random features, the kernel's width as a multiple of sqrt(statistics), ridge per row.
FEATURES, WIDTH, RIDGE, SEED = 160, 0.8, 1e-3, 20_240
BINS, LOW, HIGH = 2048, -0.5, 1.5


def projection(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(n, FEATURES)) / (WIDTH * np.sqrt(n)), rng.uniform(0, 2 * np.pi, FEATURES)


def lift(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Constant and Fourier features of raw statistics."""
    w, b = projection(x.shape[1])
    z = np.clip((x - mean) / sd, -6, 6)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in RATIOS])


def normal_equations(rows: DataFrame, mean: np.ndarray, sd: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For folds 0 and 1 of rows (RATIOS, y, fold): the sums of z z' and z y."""
    size = FEATURES + 1
    schema = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))])
    ddl = "fold int, i int, v array<double>"

    def emit(sums: dict[tuple[int, int], np.ndarray]):
        keys = sorted(sums)
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def partial(batches):
        total = {f: np.zeros((size, size + 1)) for f in (0, 1)}
        any_row = False
        for batch in batches:
            z = lift(matrix(batch), mean, sd)
            y, fold = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("y", "fold"))
            for f in (0, 1):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
                any_row |= len(own) > 0
        yield emit({(f, i): total[f][i] for f in (0, 1) for i in range(size)} if any_row else {})

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, i, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sums[f, i] = sums[f, i] + v if (f, i) in sums else np.array(v)
        yield emit(sums)

    out = {f: np.zeros((size, size + 1)) for f in (0, 1)}
    for r in rows.mapInArrow(partial, ddl).repartition("i").mapInArrow(add, ddl).collect():  # 2 x size rows
        out[r["fold"]][r["i"]] += np.array(r["v"])
    return {f: (m[:, :size], m[:, size]) for f, m in out.items()}


def ridge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = max(a[0, 0], 1.0)
    penalty = RIDGE * n * np.eye(len(b)) / FEATURES + 1e-6 * np.eye(len(b))
    penalty[0, 0] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rates that never fall, by pooling adjacent violators of counts and sums."""
    blocks: list[list[float]] = []
    for c, t in zip(n, s, strict=True):
        blocks.append([c, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c1, t1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c1, blocks[-1][1] + t1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), t / c) for c, t, k in blocks])


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Labels of ids whose crc32 modulo ``mod`` is ``held`` are not learned from.
    """
    held_out = F.coalesce(id_hash_mod("doc_id", mod) == held, F.lit(False))
    stats = cut(document_stats(docs).select("doc_id", *RATIOS).withColumn("held_out", held_out))
    known = labelled(labels, "quality").where(id_hash_mod("doc_id", mod) != held)
    rows = stats.where(~F.col("held_out")).join(known, "doc_id")
    rows = cut(rows.select(*RATIOS, F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")))
    first = rows.agg(F.count("*"), F.sum("y"), *[f(c) for c in RATIOS for f in (F.avg, F.stddev_pop)]).first()
    n, positive = first[0], first[1] or 0.0
    if not n or positive in (0, n):
        rate = positive / n if n else 0.5
        return stats.select("doc_id", "held_out", F.lit(float(rate)).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"))
    mean, sd = np.array(first[2::2], float), np.maximum(np.array(first[3::2], float), 1e-6)
    sums = normal_equations(rows, mean, sd)
    whole = ridge(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1])
    apart = {f: ridge(*sums[1 - f]) for f in (0, 1)}  # for fold f: fitted on the other

    def binned(batches):
        total = np.zeros((BINS, 2))
        for batch in batches:
            z = lift(matrix(batch), mean, sd)
            y, fold = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("y", "fold"))
            k = bin_of(np.where(fold == 0, z @ apart[0], z @ apart[1]))
            total[:, 0] += np.bincount(k, minlength=BINS)
            total[:, 1] += np.bincount(k, y, minlength=BINS)
        own = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own, 0]), pa.array(total[own, 1])], names=["bin", "n", "s"])

    counts = rows.mapInArrow(binned, "bin int, n double, s double").groupBy("bin").agg(F.sum("n"), F.sum("s")).collect()  # <= BINS rows
    counts.sort()
    bins, c, s = (np.array(x, float) for x in zip(*counts, strict=True))
    rate = isotonic(c, s)
    # the middle of each level stands for it; between levels, and within one by a hair, scores rise
    levels = np.unique(rate)
    middle = np.array([np.average(bins[rate == v], weights=c[rate == v]) for v in levels])
    at = LOW + (middle + 0.5) / BINS * (HIGH - LOW)

    def score(batches):
        for batch in batches:
            raw = lift(matrix(batch), mean, sd) @ whole
            p = 0.999 * np.interp(raw, at, levels) + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1)
            doc, held_col = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "held_out"))
            p = np.round(p, 9)
            yield pa.RecordBatch.from_arrays([doc, held_col, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")

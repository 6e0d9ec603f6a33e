"""Numeric kernels without a Spark function, as Arrow UDFs over vectors.

The beta quantile (for the conservative log ratio), the complementary error function (for
p-values) and the mean absolute deviation of the binomial (for expected dispersion).
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function of vectors, by Lentz's continued fraction."""
    shape = np.broadcast_shapes(*map(np.shape, (x, a, b)))
    x, a, b = (np.array(v, float).ravel() for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(z), 1 / safe(1 - (a + b) * z / (a + 1))
    out, ratio, at = d.copy(), np.empty_like(z), np.arange(len(z))
    for m in range(1, 5000):
        for top in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + top * d)
            c = safe(1 + top / c)
            out = out * c * d
        if m % 4 == 0:  # values that have settled leave
            open_ = np.abs(c * d - 1) >= 1e-15
            if not open_.all():
                ratio[at[~open_]] = out[~open_]
                a, b, c, d, z, out, at = (v[open_] for v in (a, b, c, d, z, out, at))
                if not len(at):
                    break
    ratio[at] = out
    value = np.where(inside, front * ratio, (x >= 1).astype(float))
    return np.where(turn, 1 - value, value).reshape(shape)


def beta_ppf(p, a, b) -> np.ndarray:
    """Quantiles of beta distributions, by bisection on the log-odds."""
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.full(p.shape, -120.0), np.full(p.shape, 120.0)
    for _ in range(58):
        mid = (low + high) / 2
        under = beta_cdf(1 / (1 + np.exp(-mid)), a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return 1 / (1 + np.exp(-(low + high) / 2))


def conservative_log_ratio(a, b, n1, n2, m) -> np.ndarray:
    """The end nearest zero of Clopper-Pearson intervals at 0.001 / m; 0 where one spans zero.

    Rows of equal counts are taken once, and whether an interval spans zero is told from the distribution at zero's
    place, so that a quantile is sought only where there is one to report.
    """
    rows = np.array(np.broadcast_arrays(a, b, n1, n2, m), float)
    if not rows.size:
        return np.zeros(rows.shape[1:])
    cases, at = np.unique(rows.reshape(5, -1), axis=1, return_inverse=True)
    a, b, n1, n2, m = cases
    alpha = 0.001 / np.maximum(m, 1)
    ok = (a + b > 0) & (n1 > 0) & (n2 > 0)
    zero = np.divide(n1, n1 + n2, out=np.full(len(a), 0.5), where=ok)
    above = ok & (a > 0) & (beta_cdf(zero, np.maximum(a, 1), b + 1) < alpha / 2)
    below = ok & (b > 0) & (beta_cdf(zero, a + 1, np.maximum(b, 1)) > 1 - alpha / 2)
    out = np.zeros(len(a))
    for some, p, x, y, end in ((above, alpha / 2, a, b + 1, np.maximum), (below, 1 - alpha / 2, a + 1, b, np.minimum)):
        q = beta_ppf(p[some], x[some], y[some])
        with np.errstate(all="ignore"):
            value = np.log2(q / (1 - q)) + np.log2(n2[some] / n1[some])
        out[some] = np.where(np.isfinite(value), end(value, 0.0), 0.0)
    return out[at.reshape(-1)].reshape(rows.shape[1:])


def binomial_mad(n: int, p: float) -> float:
    """E|X - np| of a binomial: De Moivre's closed form, normal beyond an expectation of 30."""
    if n <= 0 or p <= 0 or p >= 1:
        return 0.0
    if n * p > 30:
        return math.sqrt(2 * n * p * (1 - p) / math.pi)
    m = math.floor(n * p) + 1
    log_c = math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
    return 2 * m * math.exp(log_c + m * math.log(p) + (n - m + 1) * math.log1p(-p))


@F.pandas_udf(T.DoubleType())
def p_value(g2: pd.Series) -> pd.Series:
    """Chi-squared survival at one degree of freedom."""
    return g2.map(lambda x: math.erfc(math.sqrt(abs(x) / 2)))


@F.pandas_udf(T.DoubleType())
def lrc(a: pd.Series, b: pd.Series, n1: pd.Series, n2: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(conservative_log_ratio(a, b, n1, n2, m), dtype="float64")


@F.pandas_udf(T.DoubleType())
def expected_deviation(hits: pd.Series, share: pd.Series) -> pd.Series:
    return pd.Series([binomial_mad(int(n), p) for n, p in zip(hits, share, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of array columns, row by row; 0 if either has no length."""

    def one(x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = math.sqrt(x @ x) * math.sqrt(y @ y)
        return float(x @ y / n) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark) -> None:
    """The kernels under SQL names."""
    for name, f in {"p_value": p_value, "lrc": lrc, "expected_deviation": expected_deviation, "nfkc": nfkc}.items():
        spark.udf.register(name, f)

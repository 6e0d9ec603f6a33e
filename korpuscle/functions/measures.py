"""Association measures as column expressions.

O observed, r1 window size, c1 collocate frequency, n scope size, fu node hits; all BIGINT columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def over(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is zero."""
    return F.try_divide(_d(a), _d(b))


def cells(o: Column, r1: Column, c1: Column, n: Column) -> list[tuple[Column, Column]]:
    """(observed, expected) of the four cells."""
    o, r1, c1, n = map(_d, (o, r1, c1, n))
    return [(o, r1 * c1 / n), (r1 - o, r1 * (n - c1) / n), (c1 - o, (n - r1) * c1 / n), (n - r1 - c1 + o, (n - r1) * (n - c1) / n)]


def g2(o: Column, r1: Column, c1: Column, n: Column) -> Column:
    parts = [F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(F.lit(0.0)) for x, e in cells(o, r1, c1, n)]
    return F.greatest(F.lit(0.0), 2.0 * (parts[0] + parts[1] + parts[2] + parts[3]))


def chi2(o: Column, r1: Column, c1: Column, n: Column) -> Column:
    """All four cells, no continuity correction."""
    parts = [F.when(e > 0, (x - e) * (x - e) / e).otherwise(F.lit(0.0)) for x, e in cells(o, r1, c1, n)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def expected(r1: Column, c1: Column, n: Column) -> Column:
    return _d(r1) * _d(c1) / _d(n)


def clip(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def association(o: Column, r1: Column, c1: Column, n: Column, fu: Column) -> dict[str, Column]:
    """Every closed-form measure by name."""
    od, r, c, nd = map(_d, (o, r1, c1, n))
    e = expected(r1, c1, n)
    mi = F.log2(over(od, e))
    dice = over(2.0 * od, r + c)
    o12, o21 = r - od, c - od
    return {
        "expected": e,
        "mi": mi,
        "mi3": F.log2(over(od * od * od, e)),
        "lmi": od * mi,
        "npmi": over(mi, -F.log2(od / nd)),
        "t": over(od - e, F.sqrt(od)),
        "z": over(od - e, F.sqrt(e)),
        "chi2_cell": over((od - e) * (od - e), e),
        "ll": g2(o, r1, c1, n),
        "dice": dice,
        "logdice_window": F.when(dice > 0, 14.0 + F.log2(dice)).otherwise(F.lit(0.0)),
        "logdice": F.when(dice > 0, 14.0 + F.log2(2.0 * od / (_d(fu) + c))).otherwise(F.lit(0.0)),
        "delta_p_nc": clip(over(od, r) - over(o21, nd - r)),
        "delta_p_cn": clip(over(od, c) - over(o12, nd - c)),
        "log_ratio": F.log2(over(over(od + 0.5, r), over(o21 + 0.5, nd - r))),
    }


#: Decimal places of the displayed columns; dice is shown as it is.
DISPLAY = {"expected": 2, "chi2_cell": 2, "t": 2, "ll": 2, "mi": 4, "mi3": 4, "lmi": 4, "npmi": 4, "z": 4, "logdice": 4, "logdice_window": 4, "delta_p_nc": 4, "delta_p_cn": 4, "log_ratio": 4}


def keyness(a: Column, c: Column, nt: Column, nr: Column) -> dict[str, Column]:
    """Keyness of frequency a in nt target words against c in nr reference words."""
    ad, cd, t, r = map(_d, (a, c, nt, nr))
    rate_t, rate_r = over(1e6 * ad, t), over(1e6 * cd, r)
    sign = F.when(rate_t >= rate_r, F.lit(1.0)).otherwise(F.lit(-1.0))
    ll, x2 = g2(a, nt, a + c, nt + nr), chi2(a, nt, a + c, nt + nr)
    e = t * (ad + cd) / (t + r)
    ratio = F.log2(over(over(ad + 0.5, t), over(cd + 0.5, r)))
    se = F.sqrt(F.greatest(F.lit(0.0), 1.0 / (ad + 0.5) - 1.0 / (t + 0.5) + 1.0 / (cd + 0.5) - 1.0 / (r + 0.5))) / F.log(F.lit(2.0))
    lowest = F.least(*[x for _, x in cells(a, nt, a + c, nt + nr)])
    return {
        "target_per_million": rate_t, "reference_per_million": rate_r, "diff_per_million": rate_t - rate_r, "ll": ll, "ll_signed": sign * ll, "chi2": x2,
        "chi2_signed": sign * x2, "chi2_cell": over((ad - e) * (ad - e), e), "log_ratio": ratio, "log_ratio_low": ratio - 1.959964 * se, "log_ratio_high": ratio + 1.959964 * se,
        "bic": ll - F.log(t + r), "expected_min": lowest, "low_reliability": lowest < 5,
    }


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of k in n at 95 %, clipped to 0..1."""
    z = 1.959963984540054
    k, n = _d(k), _d(n)
    p = over(k, n)
    zz = F.lit(z * z)
    mid, half = p + over(zz, 2.0 * n), z * F.sqrt(F.greatest(F.lit(0.0), over(p * (1.0 - p), n) + over(zz, 4.0 * n * n)))
    base = 1.0 + over(zz, n)
    return F.greatest(F.lit(0.0), (mid - half) / base), F.least(F.lit(1.0), (mid + half) / base)

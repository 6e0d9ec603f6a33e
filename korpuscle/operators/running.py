"""Running sums and ranks over many rows without a window in one task.

Rows are put in buckets that follow the order; totals of the buckets, a few hundred rows, are
summed up, and a window runs inside each bucket alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


def cuts(df: DataFrame, order: str) -> list:
    """At most BUCKETS - 1 values of a column that part its rows about evenly; of strings, every 16th of a sample by hash."""
    if isinstance(df.schema[order].dataType, T.NumericType):
        return sorted(set(df.stat.approxQuantile(order, [i / BUCKETS for i in range(1, BUCKETS)], 0.25 / BUCKETS)))
    few = df.select(F.col(order).cast("string").alias("v")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(16 * BUCKETS)
    return sorted({r.v for r in few.collect()}, key=lambda v: v.encode())[16::16]


def running_start(df: DataFrame, value: str, name: str, by: list[str] | None = None, order: str = "doc_id") -> DataFrame:
    """df with the sum of ``value`` over the rows before, in the order of a number or string column (within ``by``)."""
    by = by or []
    kind = "double" if isinstance(df.schema[order].dataType, T.NumericType) else "string"
    at = cuts(df, order)
    bounds = F.array(*[F.lit(c) for c in at]) if at else F.array().cast(f"array<{kind}>")
    rows = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col(order).cast(kind))))
    totals = rows.groupBy(*by, "_b").agg(F.sum(value).alias("_t"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(*by, "_b", before(Window.partitionBy(*by).orderBy("_b"), "_t").alias("_base"))
    inside = before(Window.partitionBy(*by, "_b").orderBy(order), value)
    return rows.join(F.broadcast(base), [*by, "_b"]).withColumn(name, F.col("_base") + inside).drop("_b", "_base")

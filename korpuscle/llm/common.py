"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import cut as cut

#: Rows in an Arrow batch to a Python worker. Whole documents travel in these batches, so a
#: batch is kept small enough that a run of long documents still fits a worker.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, start: str) -> str:
    """``start``, with as many underscores behind it as no column of df, whatever its case, begins with."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def to_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def chunks(it: Iterable, n: int) -> Iterator[list]:
    out: list = []
    for x in it:
        out.append(x)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out


def id_hash_mod(col: str, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``: the folds of the labelled rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def labelled(labels: DataFrame, name: str) -> DataFrame:
    """One (doc_id, y) row for each labelled id; repeated ids take the larger label, nulls go."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(name).cast("int")).alias("y"))
    )

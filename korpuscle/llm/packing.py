"""Best-fit packing of token sequences with large-item matching.

A document's ids and one end id are cut into pieces of at most ``capacity`` tokens; only a
longer document is cut, and its first piece takes the remainder. Pieces matter to packing
by length alone, so the plan is made from the histogram of lengths, which has at most
``capacity`` rows however many documents there are:

1. a piece of full capacity has a bin to itself;
2. a piece above one third of the capacity can share its bin with only one other of its
   kind: from the longest down, each is matched with the longest that still fits;
3. the smaller pieces, longest first, go to the least gap that holds them.

Equal bins form groups with a count, and the plan is a short list of groups. A piece finds
its bin by its rank among the pieces of its length; ranks come from counts per partition
and length, so no length, however frequent, meets in one task.

Defined cases: a null text counts as empty; an empty text is one piece that holds the end
id alone; repeated rows are pieces of their own; an empty table gives no rows; other columns
of the input are ignored. Rows of equal length are told apart by their place in the input.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec_of, read_spec
from .common import bounded_batches, columns_of, cut, to_batch

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long"


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Pieces of each document with the CRC-32 of their ids (little-endian, unsigned 32-bit).

    ``task`` and ``nth`` number the pieces of a length within the task that made them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    tail = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        codec, task, seen = codec_of(spec), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                ids = codec.encode(text) + tail
                n, at, piece = len(ids) // 4, 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    own = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, piece, at, size, zlib.crc32(own), own if keep_ids else None, task, seen[size]))
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            yield to_batch(_PIECES, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DDL)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Groups of equal bins: the lengths in a bin, in order, and the number of such bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[tuple[list[int], int]] = []
    gaps: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # free tokens -> groups

    def put(items: list[int], count: int) -> None:
        free = capacity - sum(items)
        (gaps[free] if free else done).append((items, count)) if count else None

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            c = left[n]
            mate = next((m for m in large if m + n <= capacity and m <= n and left[m] > (m == n)), None)
            if mate is None:
                put([n], c)
                left[n] = 0
            elif mate == n:
                put([n, n], c // 2)
                left[n] = c % 2
            else:
                k = min(c, left[mate])
                put([n, mate], k)
                left[n] -= k
                left[mate] -= k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        sizes = sorted(g for g in gaps if gaps[g])
        while c:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                per = capacity // n
                put([n] * per, c // per)
                if c % per:
                    put([n] * (c % per), 1)
                break
            g = sizes[i]
            items, bins = gaps[g].pop()
            per = g // n  # the gap that is left after one is the least that holds the next
            k = min(bins, c // per)
            if k:
                put(items + [n] * per, k)
                c -= k * per
            if k < bins:
                if c and c < per:
                    put(items + [n] * c, 1)
                    bins, c = bins - 1, 0
                if bins - k:
                    gaps[g].append((items, bins - k))
            sizes = sorted(g for g in gaps if gaps[g])
    return done + [group for g in sorted(gaps) for group in gaps[g]]


def lay_out(groups: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first bin and offset of each run of pieces, by rank."""
    rank: Counter = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for items, bins in groups:
        at = 0
        for n in items:
            runs[n].append((rank[n], first, at))
            rank[n] += bins
            at += n
        first += bins
    return {n: tuple(np.array(x, "<i8") for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = True) -> DataFrame:
    """Pieces of (doc_id, text) with sequence_id and offset; ``ids`` is null unless kept."""
    # The pieces are kept: their numbering must not change between the counts and the end.
    pieces = cut(token_pieces(docs, path, end_id, capacity, keep_ids))
    counts = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    by_length = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # <= capacity rows
    runs = pieces.sparkSession.sparkContext.broadcast(lay_out(plan_bins(by_length, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("base")).drop("nth", "base", "task")

    out_ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            bins, offsets = np.zeros(len(n), "<i8"), np.zeros(len(n), "<i8")
            for size in np.unique(n):
                own = n == size
                starts, firsts, at = runs.value[int(size)]
                i = np.searchsorted(starts, rank[own], "right") - 1
                bins[own], offsets[own] = firsts[i] + rank[own] - starts[i], at[i]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(place, out_ddl)

"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

Fingerprints of 64 bits link at ``threshold`` (2) or fewer differing bits. The 64 bits are
read as two halves: of two linked fingerprints at least one half differs in at most one
bit. The anchors of a half are the words of the perfect Hamming code of length 31 over its
low 31 bits, whose covering radius is 1. A half's word is replicated to every anchor
within the covering radius plus the threshold of a half, 1 + 1 = 2: each word is one flip
from its own anchor c or equal to it, and if the other word differs in one more place it is
at most two flips from c, so the two meet there. A word has one anchor within one flip and
15 more at two (a code word has itself alone), so 16 to a half. At an anchor, fingerprints are compared on all
64 bits, and each is linked to the least of its own connected part there; components over
these links are the components over all linked pairs.

Only distinct fingerprints are replicated, so copies cost nothing. An anchor with more than
``PAIRS_UP_TO`` fingerprints is not compared pair by pair: every neighbour of a fingerprint
(2,080 flips of one or two bits) is looked up in the anchor's sorted list instead.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other;
repeated rows and repeated ids are rows of their own with equal results; a null doc_id is
kept, and a group's component is its smallest doc_id that is not null; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of, cut, to_batch, unused
from .components import connected_components

PAIRS_UP_TO = 3000
_LOW = {i: i + 32 for i in range(65, 91)}
#: The document contract's words.
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_CHUNK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles, repeats included."""
    words = WORDS((text or "").translate(_LOW))
    if not words:
        return 0
    h, seed = xxhash.xxh64_intdigest, 42
    if len(words) < width:
        hashes = np.array([h(" ".join(words).encode("utf-8", "surrogatepass"), seed)], "<u8")
    elif width == 3:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        hashes = np.array([h(b"%b %b %b" % x, seed) for x in zip(raw, raw[1:], raw[2:], strict=False)], "<u8")
    else:
        hashes = np.array([h(" ".join(words[i : i + width]).encode("utf-8", "surrogatepass"), seed) for i in range(len(words) - width + 1)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = [(i, (f := fingerprint(t, width)) - (f >> 63 << 64)) for i, t in zip(*columns_of(batch, "doc_id", "text"), strict=True)]
            yield to_batch(schema, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- anchors ---------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit words: the XOR of the places (from 1) of their ones."""
    out = np.zeros(len(words), np.uint32)
    for place in range(1, 32):
        out ^= np.where(words >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``words`` and the code words within two flips of each."""
    s = syndrome(words)
    rows, found = [], []
    index = np.arange(len(words))
    one = s > 0
    near = words.copy()
    near[one] ^= np.left_shift(np.uint32(1), s[one] - 1)
    rows.append(index)
    found.append(near)  # the code word itself, or the one a flip away
    for a in range(1, 32):  # two flips at places a < a ^ s
        b = s ^ np.uint32(a)
        ok = one & (b > a)
        rows.append(index[ok])
        found.append(words[ok] ^ np.uint32(1 << (a - 1)) ^ np.left_shift(np.uint32(1), b[ok] - 1))
    return np.concatenate(rows), np.concatenate(found)


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) pairs; an anchor holds its half in bit 31."""
    u = fps.view("<u8")
    out_a, out_f = [], []
    for half in (0, 1):
        words = (u >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        rows, found = anchors(words)
        out_a.append(found.astype("<i8") | half << 31)
        out_f.append(fps[rows])
    return np.concatenate(out_a), np.concatenate(out_f)


def local_links(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of distinct fingerprints to the first of their connected part."""
    fps = np.unique(fps)
    n, u = len(fps), fps.view("<u8")
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    if n <= PAIRS_UP_TO:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= threshold)
            if len(near):
                link(np.full(len(near), i), near + i + 1)
    else:
        order = np.argsort(u)
        sorted_u = u[order]
        masks = [1 << i for i in range(64)]
        if threshold > 1:
            masks += [1 << i | 1 << j for i in range(64) for j in range(i)]
        for m in masks:
            other = u ^ np.uint64(m)
            at = np.minimum(np.searchsorted(sorted_u, other), n - 1)
            hit = np.flatnonzero((sorted_u[at] == other) & (u < other))
            if len(hit):
                link(hit, order[at[hit]])
    return [(int(fps[i]), int(fps[r])) for i in range(n) if (r := root(i)) != i]


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are whole."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds of 0, 1 and 2")
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
    spark = distinct.sparkSession

    def spread(batches):
        for batch in batches:
            a, f = replicas(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(f)], schema=schema)

    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        """Anchors come sorted; one may run over several batches."""
        kept_a, kept_f = np.zeros(0, "<i8"), np.zeros(0, "<i8")

        def closed(anchor: np.ndarray, fp: np.ndarray):
            ends = np.flatnonzero(np.diff(anchor)) + 1
            starts = np.concatenate([[0], ends]) if len(anchor) else []
            sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
            out = []
            for s, n in zip(np.asarray(starts)[sizes == 2], sizes[sizes == 2], strict=True):
                x, y = int(fp[s]), int(fp[s + 1])
                if 0 < ((x ^ y) & (2**64 - 1)).bit_count() <= threshold:
                    out.append((max(x, y), min(x, y)))
            for s, n in zip(np.asarray(starts)[sizes > 2], sizes[sizes > 2], strict=True):
                out += local_links(fp[s : s + n], threshold)
            return to_batch(pairs, out)

        for batch in batches:
            anchor = np.concatenate([kept_a, batch.column(0).to_numpy()])
            fp = np.concatenate([kept_f, batch.column(1).to_numpy()])
            open_at = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            if open_at:
                yield closed(anchor[:open_at], fp[:open_at])
            kept_a, kept_f = anchor[open_at:], fp[open_at:]
        yield closed(kept_a, kept_f)

    bounded_batches(spark, 20_000)
    met = distinct.select("fp").mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long").distinct()


def components(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint; root is a fingerprint of its component."""
    distinct = prints.select("fp").distinct()
    found = connected_components(cut(links(distinct, threshold)))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """The rows of docs, all columns, less those whose group has an earlier row.

    Rows are ordered by doc_id, nulls last, then by their place; docs must read the same twice.
    """
    name = unused(docs, "korpuscle_row")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    prints = cut(fingerprints(rows.select(F.col(name).alias("doc_id"), "text"), width).join(rows.select(F.col(name).alias("doc_id"), F.col("doc_id").alias("id")), "doc_id"))
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id"))
    groups = prints.groupBy("fp").agg(F.min(place).alias("first")).join(components(prints, threshold), "fp")
    first = groups.groupBy("root").agg(F.min("first").alias("first"))
    # kept, so that both sides of the next join are dealt anew and a hot fingerprint can be split
    of = cut(groups.select("fp", "root").join(first, "root").select("fp", "first"))
    gone = prints.join(of, "fp").where(place > F.col("first")).select(F.col("doc_id").alias(name))
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = cut(fingerprints(docs, width))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(components(prints, threshold), "fp")
    comps = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    # kept, so that both sides of the last join are dealt anew and a hot fingerprint can be split
    of = cut(groups.join(comps, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Readers of CSV/TSV, JSON Lines, plain text and Parquet, each giving (id, text, metadata...) and rejects.

A row without usable text is not an error of the job: it goes to the rejects, with its
reason; ``fail_fast`` turns the first one into an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters that are tried on the head of a file.
DELIMITERS = ",;\t|"
SNIFF = 8192
MAX_LINE = 16_000_000


class ImportFailed(ValueError):
    """The first reject under fail_fast."""


@dataclass
class Imported:
    rows: DataFrame
    rejects: DataFrame

    def report(self, samples: int = 50) -> DataFrame:
        """Rejects by reason, with up to ``samples`` examples in all."""
        few = self.rejects.orderBy("reason", "sample").limit(samples)
        counts = self.rejects.groupBy("reason").agg(F.count("*").alias("n"))
        return counts.join(few.groupBy("reason").agg(F.collect_list("sample").alias("samples")), "reason", "left")

    def checked(self, policy: str = "collect") -> Imported:
        if policy not in ("collect", "fail_fast"):
            raise ValueError(f"unknown reject policy {policy!r}")
        if policy == "fail_fast" and (bad := self.rejects.first()) is not None:
            raise ImportFailed(f"{bad['reason']}: {bad['sample']}")
        return self


def _split(df: DataFrame, reason: Column, keep: list[Column]) -> Imported:
    marked = df.withColumn("_reason", reason)
    sample = F.substring(F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")])), 1, 200) if df.columns else F.lit("")
    return Imported(marked.where("_reason is null").select(*keep), marked.where("_reason is not null").select(F.col("_reason").alias("reason"), sample.alias("sample")))


def sniff_delimiter(head: str) -> str:
    """The delimiter commonest in the head, outside quotes; of equals the first tried."""
    bare = "".join(part for i, part in enumerate(head.split('"')) if i % 2 == 0)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def _finish(df: DataFrame, text: str, id_col: str | None, meta: list[str] | None) -> Imported:
    if text not in df.columns:
        raise ImportFailed(f"no column {text!r}; there are {', '.join(df.columns)}")
    body = F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")))
    number = F.monotonically_increasing_id() + 1
    ident = F.concat(F.lit("doc-"), number) if id_col is None or id_col not in df.columns else F.coalesce(F.nullif(F.trim(F.col(id_col).cast("string")), F.lit("")), F.concat(F.lit("doc-"), number))
    others = [c for c in df.columns if c not in (text, id_col) and not c.startswith("_")] if meta is None else meta
    keep = [ident.alias("id"), F.col(text).alias("text"), *[F.col(c).cast("string").alias(c) for c in others]]
    return _split(df, F.when(body == "", F.lit("empty_text_column")), keep)


def read_csv(spark: SparkSession, path: str, text: str = "text", id_col: str | None = "id", sep: str | None = None, meta: list[str] | None = None, multi_line: bool = True) -> Imported:
    """A table file with a header; the delimiter is found in its head, a byte order mark is dropped.

    Quoted fields may run over lines, which makes a file one task; ``multi_line=False`` splits large files.
    """
    if sep is None:
        head = spark.read.text(path).limit(20).collect()
        sep = sniff_delimiter("\n".join(r[0] or "" for r in head)[:SNIFF])
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line)
    return _finish(df.toDF(*[c.lstrip("﻿") for c in df.columns]), text, id_col, meta)


def read_jsonl(spark: SparkSession, path: str, text: str = "text", id_col: str | None = "id", meta: list[str] | None = None, max_line: int = MAX_LINE) -> Imported:
    """One object a line; text, id and metadata may be dotted paths."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    large = F.length("value") > max_line
    variant = F.try_parse_json(F.when(~large, F.col("value")))
    kind = F.schema_of_variant(variant)
    names = [text, *([id_col] if id_col else []), *(meta or [])]
    get = {n: F.try_variant_get(variant, "$." + n, "string") for n in names}
    df = lines.withColumn("_kind", kind).withColumn("_large", large).withColumns({f"_v{i}": get[n] for i, n in enumerate(names)})
    at = {n: F.col(f"_v{i}") for i, n in enumerate(names)}
    reason = (
        F.when(F.col("_large"), "line_too_large").when(F.col("_kind").isNull(), "malformed_json").when(~F.col("_kind").startswith("OBJECT"), "non_object_line")
        .when(F.trim(F.coalesce(at[text], F.lit(""))) == "", "empty_text_column")
    )
    auto = F.concat(F.lit("doc-"), F.monotonically_increasing_id() + 1)
    ident = F.coalesce(F.nullif(F.trim(at[id_col]), F.lit("")), auto) if id_col else auto
    return _split(df, reason, [ident.alias("id"), at[text].alias("text"), *[at[m].alias(m.replace(".", "_")) for m in meta or []]])


def read_text(spark: SparkSession, path: str, paragraphs: bool = False) -> Imported:
    """Files as documents, or their paragraphs; ``register`` is the folder that holds the file."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    name = F.element_at(F.split("_path", "/"), -1)
    df = df.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"), F.element_at(F.split("_path", "/"), -2).alias("register"))
    if paragraphs:
        df = df.select("register", "id", F.posexplode(F.split("text", r"\n\s*\n")).alias("_n", "text"))
        df = df.select(F.concat("id", F.lit("#"), "_n").alias("id"), "text", "register")
    return _finish(df, "text", "id", ["register"])


def read_parquet(spark: SparkSession, path: str, text: str = "text", id_col: str | None = "id", meta: list[str] | None = None) -> Imported:
    return _finish(spark.read.parquet(path), text, id_col, meta)


def prealigned(df: DataFrame, key: str = "pair_id", role: str = "pair_role", anchor: str = "source") -> Imported:
    """Groups with exactly one anchor and a version; others are rejected whole, with the reason."""
    has_key = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != ""
    groups = df.where(has_key).groupBy(key).agg(F.count_if(F.col(role) == anchor).alias("_anchors"), F.count("*").alias("_size"))
    marked = df.join(groups, key, "left")
    reason = (
        F.when(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", "missing_pair_key").when(F.trim(F.coalesce(F.col(role), F.lit(""))) == "", "missing_pair_role")
        .when(F.col("_size") < 2, "singleton_pair_group").when(F.col("_anchors") != 1, "invalid_anchor_count")
    )
    return _split(marked, reason, [F.col(c) for c in df.columns])

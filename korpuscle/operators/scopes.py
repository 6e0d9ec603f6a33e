"""Docsets: metadata filters, search docsets and set operations on them."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus

OPS = ("=", "!=", ">=", "<=", ">", "<")


class FilterError(ValueError):
    """A filter that cannot apply; it never means the whole corpus or no hits."""


def normal_value(v: Any) -> Any:
    """Trimmed text; blank text counts as none."""
    return (v.strip() or None) if isinstance(v, str) else v


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _same(c: Column, v: Any) -> Column:
    """Equal as text, or as numbers where column and value are numbers: 1 is 1.0."""
    same = c.cast("string") == F.lit(str(v))
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return same
    return same | (F.typeof(c).isin(*_NUMBERS) & (c.cast("string").try_cast("double") == F.lit(float(v))))


def _compare(c: Column, op: str, v: Any) -> Column:
    if op in ("=", "!="):
        same = _same(c, v)
        return same if op == "=" else ~same
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return F.lit(False)
    left, right = (c.try_cast("double"), F.lit(float(v))) if not isinstance(v, str) else (c.cast("string"), F.lit(v))
    return {">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[op]


def condition(field: str, spec: Any, column: Column) -> Column | None:
    """The test of one field; None where nothing is asked."""
    if isinstance(spec, dict):
        op = spec.get("op")
        if op == "between":
            if not {"lo", "hi"} <= spec.keys():
                raise FilterError(f"between on {field!r} needs lo and hi")
            return F.coalesce(_compare(column, ">=", spec["lo"]) & _compare(column, "<=", spec["hi"]), F.lit(False))
        if op not in OPS or "value" not in spec:
            raise FilterError(f"malformed filter on {field!r}: {spec!r}")
        return F.coalesce(_compare(column, op, normal_value(spec["value"])), F.lit(False))
    if isinstance(spec, (list, tuple, set)):
        values = [x for x in map(normal_value, spec) if x is not None]
        return F.coalesce(reduce(Column.__or__, [_same(column, x) for x in values]), F.lit(False)) if values else None
    v = normal_value(spec)
    return None if v is None else F.coalesce(_same(column, v), F.lit(False))


def docset_from_meta(corpus: Corpus, filters: dict[str, Any]) -> DataFrame:
    """Documents that meet every field's test; a field that no document has gives none."""
    if not isinstance(filters, dict):
        raise FilterError("a filter maps fields to values")
    tests = []
    for field, spec in filters.items():
        if field not in corpus.meta and field != "doc_id":
            tests.append(F.lit(False))
            continue
        test = condition(field, spec, F.col(field))
        if test is not None:
            tests.append(test)
    return corpus.docs.where(reduce(Column.__and__, tests, F.lit(True))).select("doc_id")


def docset_from_hits(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id").distinct()


def complement(corpus: Corpus, docset: DataFrame) -> DataFrame:
    return corpus.docs.select("doc_id").join(docset, "doc_id", "left_anti")


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("doc_id") for s in sets]).distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, [s.select("doc_id").distinct() for s in sets])
    return every.groupBy("doc_id").count().where(F.col("count") == len(sets)).select("doc_id")


def require_disjoint(a: DataFrame, b: DataFrame) -> None:
    if not a.join(b, "doc_id", "left_semi").isEmpty():
        raise FilterError("the two docsets share documents")


def shared_reference(groups: dict[str, DataFrame], docs: DataFrame, ref: str) -> DataFrame:
    """(group, doc_id) cut to the reference documents that every group has."""
    rows = reduce(DataFrame.unionByName, [d.select("doc_id").withColumn("grp", F.lit(g)) for g, d in groups.items()]).join(docs.select("doc_id", ref), "doc_id")
    common = rows.groupBy(ref).agg(F.count_distinct("grp").alias("k")).where(F.col("k") == len(groups)).select(ref)
    return rows.join(common, ref, "left_semi").select("grp", "doc_id")


def meta_values(corpus: Corpus) -> DataFrame:
    """field, value and n_docs of every metadata field."""
    fields = F.explode(F.array(*[F.struct(F.lit(m).alias("field"), F.col(m).cast("string").alias("value")) for m in corpus.meta])).alias("x")
    return corpus.docs.select(fields).select("x.field", "x.value").groupBy("field", "value").agg(F.count("*").alias("n_docs"))


class Subcorpora:
    """Saved definitions, resolved anew on each use; a changed schema makes one stale."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.saved = corpus, {}

    def schema_hash(self) -> str:
        return json.dumps(sorted(self.corpus.meta))

    def save(self, name: str, filters: dict[str, Any]) -> str:
        unknown = [f for f in filters if f not in self.corpus.meta]
        if unknown:
            raise FilterError(f"unknown fields: {', '.join(unknown)}")
        self.saved[name] = json.dumps({"filters": filters, "schema": self.schema_hash()})
        return self.saved[name]

    def resolve(self, name: str) -> DataFrame:
        spec = json.loads(self.saved[name])
        if spec["schema"] != self.schema_hash():
            raise FilterError(f"{name!r} was saved for other metadata fields")
        return docset_from_meta(self.corpus, spec["filters"])

    def delete(self, name: str) -> None:
        del self.saved[name]

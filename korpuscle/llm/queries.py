"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, htmltext, licenses, packing, rff, rules, simhash, toxicity, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=2, width=3)
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)
    return out.drop("ids")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_search": op3_search, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc, "op6_rules": op6_rules,
        "op7_html": op7_html, "op8_packing": op8_packing, "op9_licenses": op9_licenses, "op10_quality": op10_quality,
    }


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def search_sql() -> str:
    k1, b = bm25.K1, bm25.B
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), l AS (SELECT doc_id, len(w)::DOUBLE AS n FROM d), g AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM l),
p AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL), f AS (SELECT t, count(*)::DOUBLE AS df FROM p GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln((docs-df+0.5)/(df+0.5)+1)*p.tf*{k1 + 1}/(p.tf+{k1}*({1 - b}+{b}*n/mean))),9) AS score
FROM p q JOIN p ON p.t=q.t JOIN f ON f.t=q.t JOIN l ON l.doc_id=p.doc_id, g WHERE q.doc_id%50=0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, doc_id, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def license_sql() -> str:
    """Every word of a template found in a text starts a block of the template's width, counted by lists; no parts, order or filters of the join."""

    def strings(words: list[str]) -> str:
        return "[" + ", ".join(repr(w) for w in words) + "]::VARCHAR[]"

    def lists(rows: list[list[str]]) -> str:
        return "[" + ", ".join(strings(r) for r in rows) + "]::VARCHAR[][]"

    rows = licenses.template_rows(licenses.TEMPLATES)
    templates = ", ".join(f"('{t.label}', {strings(t.words)}, {t.need}, {t.width}, {strings(t.telling)}, {lists(t.rivals)})" for t in rows)
    places = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i+{k}]='{x}'" for k, x in enumerate(words))
        places.append(f"SELECT r, i-1 AS place, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w)-{len(words) - 2})) AS i FROM d WHERE len(w) >= {len(words)}) WHERE {test}")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
t(label, words, need, width, telling, rivals) AS (VALUES {templates}),
b AS ({" UNION ALL ".join(places)}), bb AS (SELECT r, count(*) AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word, array_to_string(list_sort(list(DISTINCT label)),',') AS base_labels FROM b GROUP BY r),
k AS (SELECT r, w, t.* FROM d, t WHERE len(list_intersect(list_distinct(w), words)) >= need),
p AS (SELECT * FROM (SELECT *, unnest(range(1, len(w)+1)) AS i FROM k) WHERE list_contains(words, w[i])),
x AS (SELECT r, label, words, need, telling, rivals, list_distinct(list_slice(w, i, i+width-1)) AS held FROM p),
m AS (SELECT r, label, len(list_intersect(held, words))::DOUBLE/len(words) AS share FROM x
WHERE len(list_intersect(held, words)) >= need AND list_has_all(held, telling) AND len([e FOR e IN rivals IF list_has_all(held, e)]) = 0),
a AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)),',') AS labels, max(share) AS share FROM (SELECT r, label, share FROM m UNION ALL SELECT r, label, 1.0 FROM b) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base,0) AS n_base, first_word, last_word, coalesce(base_labels,'') AS base_labels, coalesce(labels,'') AS labels,
CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share,0.0) END::DOUBLE AS score FROM d LEFT JOIN bb USING (r) LEFT JOIN a USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_search": search_sql(), "op9_licenses": license_sql()}

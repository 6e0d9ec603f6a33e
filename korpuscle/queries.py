"""Registered queries over the supplied tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import measures
from .functions.text import PII, is_word, mask_pii, tokens_of
from .operators import collocation, counting, deps, dispersion, keyness, kwic, pairs, ranking, scopes, vectors
from .operators.corpus import Corpus
from .plans import matching, plain

NODE, SECOND = "the", "of"
_corpora: dict[tuple[str, str], Corpus] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of the documents table; its tokens are kept for the session's other queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        _corpora[key] = Corpus.from_documents(table(spark, sf_dir, "documents"), meta=["lang", "source"], persist=True)
    return _corpora[key]


def r6(*names: str) -> list:
    """Doubles to six places, without negative zero."""
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tokens, in SQL; every oracle starts with these.
TOK = r"""WITH raw AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents),
ex AS (SELECT doc_id, lang, source, unnest(t) AS word, generate_subscripts(t,1)-1 AS tok_idx FROM raw),
tok AS (SELECT doc_id, lang, source, word, tok_idx, lower(word) AS word_lc, regexp_matches(word,'[\p{L}\p{N}]') AS is_word,
  coalesce(sum((word IN ('.','!','?'))::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS sent_id FROM ex),
docs AS (SELECT d.doc_id, d.lang, d.source, coalesce(n_tokens,0) AS n_tokens, coalesce(n_words,0) AS n_words FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (is_word) AS n_words FROM tok GROUP BY doc_id) USING (doc_id))
"""


def query(sql: str | None = None, prelude: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (TOK + sql) if prelude else sql
        return f

    return register


# -- tokens, totals, lists -------------------------------------------------------------


@query("SELECT doc_id, n_tokens, n_words FROM docs")
def tokens_per_doc(spark, d):
    return corpus(spark, d).docs.select("doc_id", "n_tokens", "n_words")


@query("SELECT count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens, sum(n_words)::BIGINT AS n_words FROM docs")
def scope_totals(spark, d):
    return corpus(spark, d).totals()


@query("SELECT word AS value, count(*) AS freq, lower(word) AS value_lc FROM tok GROUP BY word")
def lexicon(spark, d):
    return corpus(spark, d).lexicon().select("value", "freq", "value_lc")


@query("SELECT word AS value, count(*) AS freq FROM tok WHERE starts_with(word_lc,'th') GROUP BY word ORDER BY freq DESC, value LIMIT 20")
def lexicon_suggest(spark, d):
    return corpus(spark, d).suggest("th", k=20).select("value", "freq")


@query("""SELECT word_lc AS key, sum(n)::BIGINT AS freq, arg_min(word, (-n, word)) AS label FROM (SELECT word_lc, word, count(*) AS n FROM tok WHERE is_word GROUP BY ALL) GROUP BY word_lc""")
def freq_word_folded(spark, d):
    return counting.frequency(corpus(spark, d))


@query("SELECT word_lc AS key, count(*) AS freq FROM tok WHERE is_word AND word_lc NOT IN ('the','of','and') GROUP BY word_lc")
def freq_lemma_stopwords(spark, d):
    return counting.frequency(corpus(spark, d), "lemma", stopwords=["the", "of", "and"])


@query("SELECT 'X' AS key, count(*) AS freq FROM tok")
def freq_pos(spark, d):
    return counting.frequency(corpus(spark, d), "pos")


@query("""SELECT key, freq, label FROM (SELECT word_lc AS key, count(*) AS freq FROM tok WHERE is_word AND lang='de' GROUP BY word_lc)
JOIN (SELECT word_lc AS key, arg_min(word, (-n, word)) AS label FROM (SELECT word_lc, word, count(*) AS n FROM tok WHERE is_word GROUP BY ALL) GROUP BY word_lc) USING (key)""")
def freq_docset_lang(spark, d):
    c = corpus(spark, d)
    return counting.frequency(c, docset=scopes.docset_from_meta(c, {"lang": "de"}))


@query("SELECT word_lc, list_sort(list(DISTINCT word)) AS spellings FROM tok WHERE is_word GROUP BY word_lc".replace("list_sort(list(DISTINCT word)) AS spellings", "array_to_string(list_sort(list(DISTINCT word)),'|') AS spellings"))
def spelling_variants(spark, d):
    return keyness.variants(corpus(spark, d)).select("word_lc", F.array_join("spellings", "|").alias("spellings"))


def _ngram_sql(n: int) -> str:
    lead = ", ".join(f"lead(w,{k}) OVER o AS w{k}" for k in range(1, n))
    whole = " AND ".join(["w IS NOT NULL", *(f"w{k} IS NOT NULL" for k in range(1, n))])
    gram = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))])
    return f"SELECT {gram} AS ngram, count(*) AS freq FROM (SELECT w, {lead} FROM (SELECT doc_id, tok_idx, CASE WHEN is_word THEN word END AS w FROM tok) WINDOW o AS (PARTITION BY doc_id ORDER BY tok_idx)) WHERE {whole} GROUP BY 1"


@query(_ngram_sql(2))
def ngrams_2(spark, d):
    return counting.ngrams(corpus(spark, d), 2)


@query(_ngram_sql(3) + " HAVING count(*) >= 2")
def ngrams_3(spark, d):
    return counting.ngrams(corpus(spark, d), 3, min_freq=2)


@query("SELECT sum(greatest(0, n_tokens-2))::BIGINT AS positions FROM docs")
def ngram_positions_3(spark, d):
    return counting.ngram_positions(corpus(spark, d), 3)


def en_de() -> tuple:
    return F.col("lang") == "en", F.col("lang") == "de"


_RATES = "round(1e6*f_t::DOUBLE/n_t::DOUBLE,6)+0.0 AS pm_t, round(1e6*f_r::DOUBLE/n_r::DOUBLE,6)+0.0 AS pm_r, round(1e6*f_t::DOUBLE/n_t::DOUBLE-1e6*f_r::DOUBLE/n_r::DOUBLE,6)+0.0 AS diff_pm"


@query(f"""SELECT word_lc, f_t, f_r, {_RATES} FROM (SELECT word_lc, count(*) FILTER (lang='en') AS f_t, count(*) FILTER (lang='de') AS f_r FROM tok WHERE is_word AND lang IN ('en','de') GROUP BY word_lc),
(SELECT sum(n_words) FILTER (lang='en') AS n_t, sum(n_words) FILTER (lang='de') AS n_r FROM docs) WHERE greatest(f_t,f_r) >= 5""")
def freq_contrast(spark, d):
    return counting.frequency_contrast(corpus(spark, d), *en_de()).select("word_lc", "f_t", "f_r", *r6("pm_t", "pm_r", "diff_pm"))


@query(f"""SELECT ngram, f_t, f_r, {_RATES} FROM (SELECT w || ' ' || w1 AS ngram, count(*) FILTER (lang='en') AS f_t, count(*) FILTER (lang='de') AS f_r FROM
(SELECT lang, w, lead(w,1) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS w1 FROM (SELECT doc_id, lang, tok_idx, CASE WHEN is_word THEN word END AS w FROM tok WHERE lang IN ('en','de')))
WHERE w IS NOT NULL AND w1 IS NOT NULL GROUP BY 1), (SELECT sum(greatest(0,n_tokens-1)) FILTER (lang='en') AS n_t, sum(greatest(0,n_tokens-1)) FILTER (lang='de') AS n_r FROM docs) WHERE greatest(f_t,f_r) >= 5""")
def ngram_contrast(spark, d):
    return counting.ngram_contrast(corpus(spark, d), *en_de(), 2).select("ngram", "f_t", "f_r", *r6("pm_t", "pm_r", "diff_pm"))


@query("""SELECT lang, source, coalesce(sum(h),0)::BIGINT AS n_hits, count(h) AS n_docs, sum(n_words)::BIGINT AS n_words, round(1e6*coalesce(sum(h),0)::DOUBLE/sum(n_words)::DOUBLE,6)+0.0 AS per_million
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS h FROM tok WHERE word_lc='the' GROUP BY doc_id) USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def breakdown_rollup(spark, d):
    c = corpus(spark, d)
    out = counting.breakdown(c, plain.search(c, NODE), ["lang", "source"], totals=True)
    return out.select("lang", "source", "n_hits", "n_docs", "n_words", *r6("per_million"))


@query("""SELECT n_docs, h::BIGINT AS n_hits, round(h/w,6) AS rate, round(greatest(0, h/w - 1.959964*se),6)+0.0 AS low, round(h/w + 1.959964*se,6) AS high FROM (
SELECT *, sqrt(greatest(0, (hh - 2*(h/w)*hw + (h/w)*(h/w)*ww) * n/(n-1)))/w AS se FROM (SELECT count(*) FILTER (h>0) AS n_docs, count(*)::DOUBLE AS n, sum(h) AS h, sum(w) AS w, sum(h*h) AS hh, sum(h*w) AS hw, sum(w*w) AS ww
FROM (SELECT coalesce(h,0)::DOUBLE AS h, n_words::DOUBLE AS w FROM docs LEFT JOIN (SELECT doc_id, count(*) AS h FROM tok WHERE word_lc='the' GROUP BY doc_id) USING (doc_id))))""")
def hit_spread(spark, d):
    c = corpus(spark, d)
    return counting.hit_spread(c, plain.search(c, NODE)).select("n_docs", "n_hits", *r6("rate", "low", "high"))


@query("SELECT lang, count(*) AS n_hits FROM tok WHERE word_lc='the' GROUP BY lang")
def rows_by_version(spark, d):
    c = corpus(spark, d)
    return counting.rows_by_version(c, plain.search(c, NODE), "lang")


@query("""SELECT field, value, docs_t, docs_r, words_t, words_r FROM (SELECT 'source' AS field, source AS value, count(*) FILTER (lang='en') AS docs_t, count(*) FILTER (lang='de') AS docs_r,
coalesce(sum(n_words) FILTER (lang='en'),0)::BIGINT AS words_t, coalesce(sum(n_words) FILTER (lang='de'),0)::BIGINT AS words_r FROM docs WHERE lang IN ('en','de') GROUP BY source)""")
def docset_profile(spark, d):
    out = counting.docset_profile(corpus(spark, d), *en_de(), ["source"])
    return out.select("field", "value", *[F.col(f"{a}_{s}").cast("long").alias(f"{a}_{s}") for a in ("docs", "words") for s in "tr"])


# -- plain search ----------------------------------------------------------------------


def _hits(q: str):
    def f(spark, d):
        return plain.search(corpus(spark, d), q).select("doc_id", F.col("start_idx").cast("long").alias("tok_idx"))

    return f


def _search(name: str, q: str, where: str, source: str = "tok") -> None:
    f = _hits(q)
    f.__name__ = name
    query(f"SELECT doc_id, tok_idx FROM {source} WHERE {where}")(f)


_search("term_hits", "thing", "word_lc='thing'")
_search("wildcard_count", "th?n*", "regexp_full_match(word_lc,'th.n.*','s')")
_search("regex_count", "/an(ti|on)[a-z]*/", "regexp_full_match(word,'an(ti|on)[a-z]*','i')")
_search("attr_count", "[word=The]", "word='The'")
_search("bool_and_or_not", "(th* AND *n) OR (of AND NOT /OF/)", "(regexp_full_match(word_lc,'th.*') AND regexp_full_match(word_lc,'.*n')) OR (word_lc='of' AND NOT regexp_full_match(word,'OF','i'))")
_LEAD = "(SELECT *, lead(word_lc,1) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS n1 FROM tok)"
_search("phrase_positions", '"of the"', "word_lc='of' AND n1='the'", _LEAD)
_NEAR = "(SELECT *, sum((word_lc='the')::INT) OVER f AS a, sum((word_lc='of')::INT) OVER f AS b FROM tok WINDOW f AS (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"
_search("near_positions", "the NEAR/3 of", "(word_lc='the' AND b > 0) OR (word_lc='of' AND a > 0)", _NEAR)


# -- scopes ----------------------------------------------------------------------------


@query("SELECT DISTINCT doc_id FROM tok WHERE word_lc='thing'")
def docset_from_search(spark, d):
    return scopes.docset_from_hits(plain.search(corpus(spark, d), "thing"))


@query("SELECT doc_id FROM docs WHERE lang IN ('en','fr') AND source <> 'src3'")
def docset_from_meta(spark, d):
    return scopes.docset_from_meta(corpus(spark, d), {"lang": ["en", "fr"], "source": {"op": "!=", "value": "src3"}})


@query("SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE word_lc='the')")
def docset_complement(spark, d):
    c = corpus(spark, d)
    return scopes.complement(c, scopes.docset_from_hits(plain.search(c, NODE)))


@query("SELECT doc_id FROM tok WHERE word_lc='the' INTERSECT SELECT doc_id FROM tok WHERE word_lc='thing'")
def docset_intersection(spark, d):
    c = corpus(spark, d)
    return scopes.intersection(*(scopes.docset_from_hits(plain.search(c, w)) for w in (NODE, "thing")))


@query("""SELECT lang AS grp, doc_id FROM docs WHERE lang IN ('en','de') AND source IN (SELECT source FROM docs WHERE lang IN ('en','de') GROUP BY source HAVING count(DISTINCT lang)=2)""")
def docset_shared_reference(spark, d):
    c = corpus(spark, d)
    return scopes.shared_reference({g: c.docs.where(F.col("lang") == g) for g in ("en", "de")}, c.docs, "source")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n_docs FROM docs GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM docs GROUP BY source")
def meta_values(spark, d):
    return scopes.meta_values(corpus(spark, d))


# -- windows ---------------------------------------------------------------------------

_MARK = """, m AS (SELECT *, word_lc='the' AS is_start, coalesce(max((word_lc='the')::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),0) +
coalesce(max((word_lc='the')::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),0) > 0 AS in_w FROM tok{scope})
"""
_CELLS = """, x AS (SELECT collocate, o11, c1, r1, n, fu, o11::DOUBLE AS o, c1::DOUBLE AS c, r1::DOUBLE AS r, n::DOUBLE AS nd, r1::DOUBLE*c1::DOUBLE/n::DOUBLE AS e
FROM (SELECT word AS collocate, sum(in_w::INT)::BIGINT AS o11, count(*) AS c1 FROM m GROUP BY word), (SELECT sum(in_w::INT)::BIGINT AS r1, count(*) AS n, sum(is_start::INT)::BIGINT AS fu FROM m)
WHERE o11 >= 5 AND regexp_matches(collocate,'[\\p{L}\\p{N}]') AND lower(collocate) <> 'the')
"""
_G2 = "greatest(0.0, 2.0*({}))".format(" + ".join(f"CASE WHEN {x} > 0 AND {e} > 0 THEN ({x})*ln(({x})/({e})) ELSE 0.0 END" for x, e in (("o", "r*c/nd"), ("(r-o)", "r*(nd-c)/nd"), ("(c-o)", "(nd-r)*c/nd"), ("(nd-r-c+o)", "(nd-r)*(nd-c)/nd"))))
_MEASURES = {
    "expected": "e", "mi": "log2(o/e)", "mi3": "log2(o*o*o/e)", "lmi": "o*log2(o/e)", "npmi": "log2(o/e)/(-log2(o/nd))", "t": "(o-e)/sqrt(o)", "z": "(o-e)/sqrt(e)", "chi2_cell": "(o-e)*(o-e)/e", "ll": _G2,
    "dice": "2*o/(r+c)", "logdice_window": "14+log2(2*o/(r+c))", "logdice": "14+log2(2*o/(fu::DOUBLE+c))", "delta_p_nc": "o/r-(c-o)/(nd-r)", "delta_p_cn": "o/c-(r-o)/(nd-c)",
    "log_ratio": "log2(((o+0.5)/r)/(((c-o)+0.5)/(nd-r)))",
}
_ROUNDED = ", ".join(f"round({e},6)+0.0 AS {k}" for k, e in _MEASURES.items())


@query(_MARK.format(scope="") + "SELECT word AS collocate, sum(in_w::INT)::BIGINT AS o11, count(*) AS c1 FROM m GROUP BY word HAVING sum(in_w::INT) > 0")
def colloc_counts(spark, d):
    return collocation.counts(corpus(spark, d), collocation.node_condition(NODE), 5, "s").select("collocate", "o11", "c1")


@query(_MARK.format(scope="") + _CELLS + f"SELECT collocate, o11, c1, r1, n, fu, {_ROUNDED} FROM x")
def colloc_measures(spark, d):
    out = collocation.collocates(corpus(spark, d), NODE, 5, "s", min_freq=5)
    return out.select("collocate", "o11", "c1", "r1", "n", "fu", *r6(*_MEASURES))


@query(_MARK.format(scope=" WHERE source IN ('src1','src2')") + _CELLS + "SELECT collocate, o11, c1, r1, n, round(logdice,6) AS logdice FROM (SELECT *, 14+log2(2*o/(fu::DOUBLE+c)) AS logdice FROM x) ORDER BY logdice DESC, collocate LIMIT 50")
def colloc_docset(spark, d):
    c = corpus(spark, d)
    rows = collocation.collocates(c.scope(scopes.docset_from_meta(c, {"source": ["src1", "src2"]})), NODE, 5, "s", min_freq=5)
    return collocation.ranked(rows, "logdice", 50).select("collocate", "o11", "c1", "r1", "n", *r6("logdice"))


_SIDE = """, p AS (SELECT word AS collocate, coalesce(sum(in_w::INT) FILTER (source IN ('src1','src2','src3')),0)::BIGINT AS o_t, coalesce(sum(in_w::INT) FILTER (source NOT IN ('src1','src2','src3')),0)::BIGINT AS o_r,
count(*) FILTER (source IN ('src1','src2','src3')) AS c_t, count(*) FILTER (source NOT IN ('src1','src2','src3')) AS c_r FROM m GROUP BY word),
s AS (SELECT sum(o_t)::DOUBLE AS r1_t, sum(o_r)::DOUBLE AS r1_r, sum(c_t)::DOUBLE AS n_t, sum(c_r)::DOUBLE AS n_r FROM p)
"""


@query(_MARK.format(scope="") + _SIDE + """SELECT collocate, o_t AS target_freq, o_r AS reference_freq, round(2.0*o_t/(r1_t+c_t),6)+0.0 AS target_score, round(2.0*o_r/(r1_r+c_r),6)+0.0 AS reference_score,
round(1e6*o_t/n_t - 1e6*o_r/n_r,6)+0.0 AS diff_per_million, round(log2(((o_t+0.5)/n_t)/((o_r+0.5)/n_r)),6)+0.0 AS log_ratio, (o_t=0) <> (o_r=0) AS one_sided FROM p, s WHERE greatest(o_t,o_r) >= 5""")
def colloc_contrast(spark, d):
    t = F.col("source").isin("src1", "src2", "src3")
    out = collocation.contrast(corpus(spark, d), NODE, t, ~t)
    return out.select("collocate", "target_freq", "reference_freq", *r6("target_score", "reference_score", "diff_per_million", "log_ratio"), "one_sided")


@query("""SELECT doc_id, tok_idx FROM (SELECT *, sum((word_lc='of')::INT) OVER f AS a, sum((word_lc='and')::INT) OVER f AS b FROM tok
WINDOW f AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE word_lc='the' AND a > 0 AND b > 0""")
def co_kwic(spark, d):
    return collocation.co_occurrence(corpus(spark, d), NODE, ["of", "and"]).select("doc_id", F.col("start_idx").cast("long").alias("tok_idx"))


_KEY = {
    "diff_per_million": "1e6*a/t-1e6*c/r", "ll": None, "chi2": None, "chi2_cell": "(a-e)*(a-e)/e", "log_ratio": "lr", "log_ratio_low": "lr-1.959964*se", "log_ratio_high": "lr+1.959964*se", "bic": None, "expected_min": None,
}
_KCELLS = (("a", "t*(a+c)/(t+r)"), ("(t-a)", "t*(t+r-a-c)/(t+r)"), ("c", "r*(a+c)/(t+r)"), ("(r-c)", "r*(t+r-a-c)/(t+r)"))
_KLL = "greatest(0.0, 2.0*({}))".format(" + ".join(f"CASE WHEN {x} > 0 AND {e} > 0 THEN ({x})*ln(({x})/({e})) ELSE 0.0 END" for x, e in _KCELLS))
_KEY |= {"ll": _KLL, "chi2": " + ".join(f"(({x})-({e}))*(({x})-({e}))/({e})" for x, e in _KCELLS), "bic": f"{_KLL}-ln(t+r)", "expected_min": f"least({', '.join(e for _, e in _KCELLS)})"}
_KSQL = """SELECT word_lc, ai AS a, ci AS c, {cols} FROM (SELECT *, t*(a+c)/(t+r) AS e, log2(((a+0.5)/t)/((c+0.5)/r)) AS lr, sqrt(greatest(0.0, 1/(a+0.5)-1/(t+0.5)+1/(c+0.5)-1/(r+0.5)))/ln(2) AS se
FROM (SELECT word_lc, a AS ai, c AS ci, a::DOUBLE AS a, c::DOUBLE AS c, t::DOUBLE AS t, r::DOUBLE AS r FROM k, (SELECT sum(a) AS t, sum(c) AS r FROM k) WHERE a + c >= 5))"""
_KCOLS = ", ".join(f"round({e},6)+0.0 AS {k}" for k, e in _KEY.items())


@query(", k AS (SELECT word_lc, count(*) FILTER (lang='en') AS a, count(*) FILTER (lang='de') AS c FROM tok WHERE is_word AND lang IN ('en','de') GROUP BY word_lc) " + _KSQL.format(cols=_KCOLS))
def keyness_stats(spark, d):
    return keyness.keyness(corpus(spark, d), *en_de(), inference=False).select("word_lc", "a", "c", *r6(*_KEY))


@query()
def keyness_inference(spark, d):
    """p-values, q-values and conservative log ratios need functions that SQL lacks."""
    return keyness.keyness(corpus(spark, d), *en_de())


@query(_MARK.format(scope="") + ", k AS (SELECT word_lc, count(*) FILTER (in_w) AS a, count(*) FILTER (NOT in_w) AS c FROM m WHERE is_word AND (NOT is_start OR in_w) GROUP BY word_lc) " + _KSQL.format(cols=", ".join(f"round({_KEY[k]},6)+0.0 AS {k}" for k in ("ll", "log_ratio", "bic"))))
def context_keyness(spark, d):
    return collocation.context_keyness(corpus(spark, d), NODE).select("word_lc", "a", "c", *r6("ll", "log_ratio", "bic"))


@query()
def colloc_lrc(spark, d):
    return collocation.collocates(corpus(spark, d), NODE, 5, "s", min_freq=5, with_lrc=True).select("collocate", "o11", "lrc")


_FLOOR = "CASE WHEN fu >= 50 THEN 5 ELSE greatest(2, least(fu//10, 5)) END"


@query(_MARK.format(scope="") + f""", c AS (SELECT word AS collocate, sum(in_w::INT) AS o, count(*) AS c FROM m GROUP BY word),
ego AS (SELECT lower(collocate) AS target, w, row_number() OVER (ORDER BY w DESC, collocate) AS rk FROM (SELECT collocate, 14+log2(2.0*o/(fu+c)) AS w FROM c, (SELECT sum(is_start::INT) AS fu FROM m)
  WHERE o >= {_FLOOR} AND regexp_matches(collocate,'[\\p{{L}}\\p{{N}}]') AND lower(collocate) <> 'the') ORDER BY w DESC, collocate LIMIT 19),
met AS (SELECT DISTINCT t.doc_id, t.tok_idx, t.word_lc, t.is_word, h.word_lc AS hub FROM tok h JOIN tok t ON h.doc_id=t.doc_id AND h.sent_id=t.sent_id AND h.tok_idx<>t.tok_idx AND abs(h.tok_idx-t.tok_idx) <= 5
  WHERE h.word_lc IN (SELECT target FROM ego WHERE rk <= 9)),
f AS (SELECT word_lc, count(*) AS c1 FROM tok GROUP BY word_lc),
ring AS (SELECT hub, p.word_lc, 14+log2(2.0*o11/(h.c1+f.c1)) AS w FROM (SELECT hub, word_lc, count(*) AS o11, bool_and(is_word) AS ok FROM met GROUP BY ALL) p JOIN (SELECT word_lc AS hub, c1, c1 AS fu FROM f) h USING (hub) JOIN f ON f.word_lc=p.word_lc
  WHERE ok AND hub <> p.word_lc AND (p.word_lc='the' OR p.word_lc IN (SELECT target FROM ego)) AND o11 >= {_FLOOR}),
edges AS (SELECT 'the' AS source, target, w, 1 AS depth, rk FROM ego UNION ALL SELECT hub, word_lc, w, 2, row_number() OVER (ORDER BY hub, w DESC, word_lc) FROM ring)
SELECT source, target, round(w,6) AS weight, depth FROM edges QUALIFY row_number() OVER (PARTITION BY least(source,target), greatest(source,target) ORDER BY depth, rk) = 1""")
def colloc_network(spark, d):
    return collocation.network(corpus(spark, d), NODE, depth=2, nodes=20).select("source", "target", *r6("weight"), "depth")


@query(""", h AS (SELECT *, coalesce(word_lc='of' AND lead(word_lc) OVER g='the', false) AS is_start, coalesce(word_lc='the' AND lag(word_lc) OVER g='of', false) AS is_last FROM tok WINDOW g AS (PARTITION BY doc_id ORDER BY tok_idx)),
m AS (SELECT *, coalesce(max(is_start::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),0) + coalesce(max(is_last::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),0) > 0 AS in_w FROM h)
SELECT collocate, o11, c1, r1, n, fu, round(14+log2(2.0*o11/(fu+c1)),6)+0.0 AS logdice FROM (SELECT word AS collocate, sum(in_w::INT)::BIGINT AS o11, count(*) AS c1 FROM m GROUP BY word),
(SELECT sum(in_w::INT)::BIGINT AS r1, count(*) AS n, sum(is_start::INT)::BIGINT AS fu FROM m) WHERE o11 >= 3 AND regexp_matches(collocate,'[\\p{L}\\p{N}]')""")
def colloc_phrase(spark, d):
    """Collocates of a node of two tokens: its window starts at either end of the hit."""
    c = Corpus.from_documents(table(spark, d, "documents"), meta=[], deal=False)  # neither kept nor dealt: only documents with a hit get windows
    out = collocation.collocates(c, plain.search(c, '"of the"'), 3, "s", min_freq=3)
    return out.select("collocate", "o11", "c1", "r1", "n", "fu", *r6("logdice"))


#: The turns of the conversations as documents, their roles in place of languages.
_TURNS = TOK.replace("documents", "(SELECT conv_id*1000+turn AS doc_id, role AS lang, '' AS source, text FROM conversations)")
_USER = _SIDE.replace("source IN ('src1','src2','src3')", "lang='user'").replace("source NOT IN ('src1','src2','src3')", "lang<>'user'")


@query(_TURNS + _MARK.format(scope="") + _USER + """SELECT collocate, o_t AS target_freq, o_r AS reference_freq, round(1e6*o_t/n_t - 1e6*o_r/n_r,6)+0.0 AS diff_per_million,
round(log2(((o_t+0.5)/n_t)/((o_r+0.5)/n_r)),6)+0.0 AS log_ratio FROM p, s WHERE greatest(o_t,o_r) >= 2""", prelude=False)
def colloc_versions(spark, d):
    """Collocates in users' turns against those in all other turns of the conversations."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text")
    out = collocation.version_contrast(Corpus.from_documents(turns, meta=["role"]), NODE, "role", "user", min_freq=2)
    return out.select("collocate", "target_freq", "reference_freq", *r6("diff_per_million", "log_ratio"))


# -- dispersion, trend, diversity ------------------------------------------------------

_PROFILE = ", p AS (SELECT n_tokens AS s, coalesce(h,0) AS o FROM docs LEFT JOIN (SELECT doc_id, count(*) AS h FROM tok WHERE word_lc='the' GROUP BY doc_id) USING (doc_id)), z AS (SELECT o::DOUBLE AS o, s::DOUBLE AS s, f::DOUBLE AS f, n::DOUBLE AS n FROM p, (SELECT sum(o) AS f, sum(s) AS n FROM p)) "


@query(_PROFILE + "SELECT max(f)::BIGINT AS hits, count(*) AS n_docs, count(*) FILTER (o>0) AS range, round(0.5*sum(abs(o/f-s/n)),6) AS dp, round(0.5*sum(abs(o/f-s/n))/(1-min(s/n)),6) AS dpnorm, round(1-min(s/n),6) AS dp_max FROM z")
def dispersion_dp(spark, d):
    c = corpus(spark, d)
    return dispersion.family(dispersion.profile(c, plain.search(c, NODE))).select("hits", "n_docs", "range", *r6("dp", "dpnorm", "dp_max"))


@query(_PROFILE + """SELECT round(vc,6) AS vc, round(greatest(0,least(1,1-vc/sqrt(k-1))),6)+0.0 AS juilland_d, round(greatest(0,least(1,h/ln(k))),6)+0.0 AS carroll_d2 FROM
(SELECT sqrt(greatest(0.0,avg(v*v)-avg(v)*avg(v)))/avg(v) AS vc, count(*)::DOUBLE AS k, -sum(CASE WHEN o>0 THEN o/f*ln(o/f) END) AS h FROM (SELECT *, CASE WHEN s>0 THEN o/s ELSE 0 END AS v FROM z))""")
def dispersion_family(spark, d):
    c = corpus(spark, d)
    return dispersion.family(dispersion.profile(c, plain.search(c, NODE))).select(*r6("vc", "juilland_d", "carroll_d2"))


@query(_PROFILE + """, q AS (SELECT *, s/n AS p, f*(s/n) AS ideal, floor(f*(s/n)) AS base, floor(f*(s/n))+1 AS k FROM z),
w AS (SELECT *, CASE WHEN ideal > 30 THEN sqrt(2*ideal*(1-p)/pi()) WHEN p > 0 AND p < 1 THEN 2*k*exp(lgamma(f+1)-lgamma(k+1)-lgamma(f-k+1)+k*ln(p)+(f-k+1)*ln(1-p)) ELSE 0 END AS mad,
  CASE WHEN row_number() OVER (ORDER BY ideal-base DESC, s) <= f - sum(base) OVER () THEN base+1 ELSE base END AS even FROM q),
v AS (SELECT max(f)::BIGINT AS hits, count(*) AS n_docs, count(*) FILTER (o>0) AS range, 0.5*sum(abs(o/f-p)) AS dp, 0.5*sum(abs(even/f-p)) AS dp_min, 0.5*sum(mad)/max(f) AS dp_expected, 1-min(p) AS dp_max FROM w)
SELECT hits, n_docs, range, round(dp,6) AS dp, round(dp_min,6) AS dp_min, round(dp_expected,6) AS dp_expected, round(dp_max,6) AS dp_max, CASE WHEN dp_max-dp_min < 0.05 THEN 'too_few_hits' WHEN dp <= 0.75*dp_expected THEN 'even'
WHEN dp <= dp_expected THEN 'fairly_even' WHEN (dp-dp_expected)/(dp_max-dp_expected) >= 0.5 THEN 'clustered' ELSE 'fairly_clustered' END AS label FROM v""")
def dispersion_expected(spark, d):
    c = corpus(spark, d)
    return dispersion.dispersion(c, plain.search(c, NODE)).select("hits", "n_docs", "range", *r6("dp", "dp_min", "dp_expected", "dp_max"), "label")


@query("SELECT doc_id, floor(tok_idx::DOUBLE*20/n_tokens)::INT AS bin, count(*) AS n_hits FROM tok JOIN docs USING (doc_id) WHERE word_lc='the' GROUP BY ALL")
def dispersion_offsets(spark, d):
    c = corpus(spark, d)
    return dispersion.offsets(c, plain.search(c, NODE))


@query(
    """WITH x AS (SELECT strftime(ts,'%Y-%m') AS period, count(*) FILTER (event_type='click')::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1)
SELECT period, k::BIGINT AS n_hits, n::BIGINT AS n_words, round(1e6*k/n,4) AS per_million, round(1e6*greatest(0,(k/n + z*z/(2*n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)))/(1+z*z/n)),4)+0.0 AS low,
round(1e6*least(1,(k/n + z*z/(2*n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)))/(1+z*z/n)),4) AS high FROM (SELECT *, 1.959963984540054::DOUBLE AS z FROM x) ORDER BY period LIMIT 500""",
    prelude=False,
)
def trend_wilson(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit(1).cast("long").alias("n_words"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_type")
    out = dispersion.trend(e, e.where("event_type = 'click'").select("doc_id"), "date", "month")
    return out.select("period", "n_hits", "n_words", *[(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) for c in ("per_million", "low", "high")])


@query("SELECT count(*) AS types, sum(c)::BIGINT AS words, round(count(*)::DOUBLE/sum(c),6) AS ttr, round(count(*)::DOUBLE/sqrt(sum(c)::DOUBLE),6) AS guiraud FROM (SELECT word, count(*) AS c FROM tok WHERE is_word GROUP BY word)")
def ttr_guiraud(spark, d):
    return dispersion.type_token(corpus(spark, d)).select("types", "words", *r6("ttr", "guiraud"))


@query("""SELECT lang, types, words, round(types::DOUBLE/words,6) AS ttr, min(words) OVER () < 0.8*max(words) OVER () AS uneven FROM (SELECT lang, count(DISTINCT word) AS types, count(*) AS words FROM tok WHERE is_word GROUP BY lang)""")
def diversity_per_side(spark, d):
    return dispersion.per_side(corpus(spark, d), "lang").select("lang", "types", "words", *r6("ttr"), "uneven")


_STREAM = ", w AS (SELECT word, row_number() OVER (ORDER BY doc_id, tok_idx)-1 AS i FROM tok WHERE is_word) "


@query(_STREAM + "SELECT count(*) AS windows, round(sum(v)::DOUBLE/(count(*)*1000),6) AS sttr FROM (SELECT i//1000 AS b, count(*) AS n, count(DISTINCT word) AS v FROM w GROUP BY 1) WHERE n = 1000")
def sttr(spark, d):
    return dispersion.sttr(corpus(spark, d)).select("windows", *r6("sttr"))


@query(_STREAM + "SELECT round(sum(greatest(0, least(i, n-500) - greatest(prev+1, i-499, 0) + 1))::DOUBLE/((max(n)-499)::DOUBLE*500),6) AS mattr FROM (SELECT i, coalesce(lag(i) OVER (PARTITION BY word ORDER BY i),-1) AS prev FROM w), (SELECT count(*) AS n FROM w)")
def mattr(spark, d):
    return dispersion.mattr(corpus(spark, d)).select(*r6("mattr"))


# -- patterns --------------------------------------------------------------------------


def _pattern(q: str):
    def f(spark, d):
        return matching.match(corpus(spark, d), q).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start_idx", "end_idx")])

    return f


def _cql(name: str, q: str, sql: str | None) -> None:
    f = _pattern(q)
    f.__name__ = name
    query(sql)(f)


_NEXT = "(SELECT *, lead(word,1) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS n1, lead(word,2) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS n2 FROM tok)"
_cql("cql_seq2", '[word="of"] [word="the"%c]', f"SELECT doc_id, tok_idx AS start_idx, tok_idx+2 AS end_idx FROM {_NEXT} WHERE word='of' AND lower(n1)='the'")
_cql("cql_where", 'where(lang="en" & source!="src1", [word="the"])', "SELECT doc_id, tok_idx AS start_idx, tok_idx+1 AS end_idx FROM tok WHERE lang='en' AND source<>'src1' AND word='the'")
# of a run of "of" every second one starts a hit, as hits do not overlap
_cql("cql_neq_ci", '[word="of"] [word!="the"%c & word~"[a-z]+"%c]', f"""SELECT doc_id, tok_idx AS start_idx, tok_idx+2 AS end_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, island ORDER BY tok_idx) AS i
FROM (SELECT *, tok_idx - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS island FROM {_NEXT} WHERE word='of')) WHERE i % 2 = 1 AND lower(n1)<>'the' AND regexp_full_match(n1,'[a-z]+','i')""")
_cql("cql_in_set", '[word in {"of","to"}%c] [] [word="th.*"]', f"""SELECT doc_id, tok_idx AS start_idx, tok_idx+3 AS end_idx FROM (SELECT *, max(CASE WHEN ok THEN tok_idx END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before
FROM (SELECT *, lower(word) IN ('of','to') AND regexp_full_match(n2,'th.*') AS ok FROM {_NEXT})) WHERE ok AND before IS NULL""")
_cql("cql_gap_nfa", '[word="of"] [word!="of"]{0,3} [word="the"]', """SELECT doc_id, tok_idx AS start_idx, last+1 AS end_idx FROM (SELECT *, max(CASE WHEN word='the' THEN tok_idx END) OVER (PARTITION BY doc_id, sent_id, grp ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS last
FROM (SELECT *, sum((word='of')::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS grp FROM tok)) WHERE word='of' AND last IS NOT NULL""")
_cql("cql_alternation", '([word="of"] | [word="to"] [word="be"]) [word="the"]', f"""SELECT doc_id, tok_idx AS start_idx, tok_idx+2 AS end_idx FROM {_NEXT} WHERE word='of' AND n1='the'
UNION ALL SELECT doc_id, tok_idx, tok_idx+3 FROM {_NEXT} WHERE word='to' AND n1='be' AND n2='the'""")
_cql("cql_within_doc", r'within(<doc>, [word="\."] [word="The"])', "SELECT doc_id, tok_idx AS start_idx, tok_idx+2 AS end_idx FROM (SELECT *, lead(word,1) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS n1 FROM tok) WHERE word='.' AND n1='The'")


@query("SELECT sum(freq)::BIGINT AS n_hits, count(*) AS n_types FROM (SELECT word, count(*) AS freq FROM tok WHERE regexp_full_match(word,'th.*') GROUP BY word)")
def cql_type_count(spark, d):
    return matching.type_count(corpus(spark, d), "word", "th.*")


# -- annotated tokens ------------------------------------------------------------------

#: Tags, readings and heads by rule over the documents' tokens, to query what a real annotation carries.
_ANN_SQL = r""", ann AS (SELECT *, CASE WHEN NOT is_word THEN 'PUNCT' WHEN regexp_matches(word,'^\p{Lu}') THEN 'NAME' ELSE 'WORD' END AS pos_tag, CASE WHEN regexp_matches(word_lc,'..s$') THEN word_lc || '|' || word_lc[:-2] ELSE word_lc END AS lemma,
CASE WHEN tok_idx=0 THEN 'ROOT' WHEN NOT is_word THEN 'punct' WHEN tok_idx%2=0 THEN 'mod' ELSE 'obj' END AS rel, greatest(tok_idx-1-tok_idx%2, 0) AS head_idx FROM tok) """


def annotated(spark, d) -> Corpus:
    """The documents' tokens with tag, lemma, relation and head by rule; half of the heads are one token before, half two."""
    c, i = corpus(spark, d), F.col("tok_idx")
    tag = F.when(~F.col("is_word"), "PUNCT").when(F.col("word").rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
    two = F.concat("word_lc", F.lit("|"), F.expr("substr(word_lc, 1, length(word_lc) - 1)"))
    rel = F.when(i == 0, "ROOT").when(~F.col("is_word"), "punct").when(i % 2 == 0, "mod").otherwise("obj")
    tokens = c.tokens.withColumns({"pos_tag": tag, "lemma": F.when(F.col("word_lc").rlike("..s$"), two).otherwise(F.col("word_lc")), "rel": rel, "head_idx": F.greatest(i - 1 - i % 2, F.lit(0))})
    return Corpus(tokens, c.docs, c.meta)


@query(_ANN_SQL + "SELECT pos_tag AS key, count(*) AS freq FROM ann GROUP BY pos_tag")
def freq_tags(spark, d):
    return counting.frequency(annotated(spark, d), "pos")


@query(_ANN_SQL + "SELECT word_lc AS key, count(*) AS freq FROM ann WHERE is_word AND pos_tag='NAME' GROUP BY word_lc")
def freq_of_tag(spark, d):
    return counting.frequency(annotated(spark, d), "word", pos="NAME", with_labels=False)


@query(_ANN_SQL + "SELECT lemma, reading, count(*) AS freq FROM (SELECT lemma, unnest(string_split(lemma,'|')) AS reading FROM ann WHERE contains(lemma,'|')) WHERE reading <> '' GROUP BY ALL")
def lemma_readings(spark, d):
    return counting.alternative_lemmas(annotated(spark, d))


@query(_ANN_SQL + ", k AS (SELECT word_lc, count(*) FILTER (lang='en') AS a, count(*) FILTER (lang='de') AS c FROM ann WHERE is_word AND pos_tag='NAME' AND lang IN ('en','de') GROUP BY word_lc) " + _KSQL.format(cols=_KCOLS))
def keyness_of_tag(spark, d):
    return keyness.keyness(annotated(spark, d), *en_de(), pos="NAME", inference=False).select("word_lc", "a", "c", *r6(*_KEY))


@query(_ANN_SQL + """SELECT doc_id, tok_idx AS start_idx, tok_idx+2 AS end_idx FROM (SELECT *, lead(pos_tag) OVER w AS p1, lead(lemma) OVER w AS l1 FROM ann WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx)) WHERE pos_tag='NAME' AND p1='WORD' AND l1='of'""")
def cql_annotated(spark, d):
    return matching.match(annotated(spark, d), '[pos="NAME"] [pos="WORD" & lemma="of"]').select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start_idx", "end_idx")])


@query(_ANN_SQL + "SELECT doc_id, tok_idx FROM ann h WHERE word_lc='of' AND EXISTS (SELECT 1 FROM ann x WHERE x.doc_id=h.doc_id AND x.head_idx=h.tok_idx AND x.tok_idx<>h.tok_idx AND x.rel='mod' AND x.word_lc='the')")
def dependency_hits(spark, d):
    return plain.search(annotated(spark, d), "of >mod the").select("doc_id", F.col("start_idx").cast("long").alias("tok_idx"))


_ARCS = _ANN_SQL + ", arcs AS (SELECT x.rel, x.word AS dep, h.word AS head FROM ann x JOIN ann h ON h.doc_id=x.doc_id AND h.tok_idx=x.head_idx WHERE x.head_idx<>x.tok_idx)"


@query(_ARCS + "SELECT rel, head, count(*) AS n FROM arcs GROUP BY ALL")
def dependency_arcs(spark, d):
    return deps.arcs(annotated(spark, d)).groupBy("rel", "head").agg(F.count("*").alias("n"))


@query(_ARCS + f""", s AS (SELECT rel AS relation, dep AS word FROM arcs WHERE head='the' UNION ALL SELECT rel || '_rev', head FROM arcs WHERE dep='the'), fr AS (SELECT word, count(*) AS f2 FROM tok GROUP BY word),
x AS (SELECT relation, word, f, f1, f2, n, f::DOUBLE AS o, f1::DOUBLE AS r, f2::DOUBLE AS c, n::DOUBLE AS nd FROM (SELECT relation, word, count(*) AS f FROM s WHERE relation NOT IN ('ROOT','punct','ROOT_rev','punct_rev') GROUP BY ALL) JOIN fr USING (word),
  (SELECT sum(f2)::BIGINT AS n, coalesce(sum(f2) FILTER (word='the'),0)::BIGINT AS f1 FROM fr) WHERE f >= 3 AND regexp_matches(word,'[\\p{{L}}\\p{{N}}]'))
SELECT relation, word, f, f1, f2, n, round((o-r*c/nd)/sqrt(o),6)+0.0 AS t, round({_G2},6)+0.0 AS ll, round(2*o/(r+c),6) AS dice, round(14+log2(2*o/(r+c)),6)+0.0 AS logdice
FROM x QUALIFY lower(word)<>'the' OR count(*) FILTER (lower(word)<>'the') OVER (PARTITION BY relation) = 0""")
def word_sketch(spark, d):
    return deps.sketch(annotated(spark, d), NODE, 3).select("relation", "word", "f", "f1", "f2", "n", *r6("t", "ll", "dice", "logdice"))


@query(""", o AS (SELECT word_lc, count(*) AS a FROM tok WHERE is_word GROUP BY word_lc),
e AS (SELECT lower(word) AS word_lc, count(*) AS c FROM (SELECT unnest(regexp_extract_all(coalesce(text,''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS word FROM conversations) WHERE regexp_matches(word,'[\\p{L}\\p{N}]') GROUP BY ALL),
k AS (SELECT word_lc, coalesce(a,0) AS a, coalesce(c,0) AS c FROM o FULL JOIN e USING (word_lc)) """ + _KSQL.format(cols=_KCOLS))
def keyness_external(spark, d):
    """Against the word list of the conversations."""
    words = table(spark, d, "conversations").select(F.explode(tokens_of(F.col("text"))).alias("word")).where(is_word(F.col("word")))
    listed = words.groupBy("word").agg(F.count("*").alias("freq"))
    total = listed.agg(F.sum("freq")).first()[0]
    return keyness.external(corpus(spark, d), listed, total).select("word_lc", "a", "c", *r6(*_KEY))


@query("SELECT doc_id FROM tok WHERE word_lc='the' UNION SELECT doc_id FROM tok WHERE word_lc='thing'")
def docset_union(spark, d):
    c = corpus(spark, d)
    return scopes.union(scopes.docset_from_hits(plain.search(c, "the")), scopes.docset_from_hits(plain.search(c, "thing"))).select("doc_id")


# -- concordances ----------------------------------------------------------------------

_ARR = ", a AS (SELECT doc_id, list(word ORDER BY tok_idx) AS w FROM tok GROUP BY doc_id), k AS (SELECT doc_id, tok_idx AS match_start, tok_idx+1 AS match_end, array_to_string(w[greatest(1,tok_idx-4):tok_idx],' ') AS \"left\", w[tok_idx+1] AS node, array_to_string(w[tok_idx+2:tok_idx+6],' ') AS \"right\" FROM tok JOIN a USING (doc_id) WHERE word_lc='thing') "
_KWIC = ("doc_id", "left", "node", "right")


def _lines(spark, d):
    c = corpus(spark, d)
    return kwic.lines(c, plain.search(c, "thing"), 5)


def _out(rows):
    return rows.select(*_KWIC, *[F.col(c).cast("long").alias(c) for c in ("match_start", "match_end")])


@query(_ARR + 'SELECT doc_id, "left", node, "right", match_start, match_end FROM k')
def kwic_rows(spark, d):
    return _out(_lines(spark, d))


@query(_ARR + """SELECT doc_id, "left", node, "right", match_start, match_end FROM k ORDER BY translate(replace(lower(split_part("right",' ',1)),'ß','ss'),'äöü','aou'), doc_id, match_start LIMIT 50""")
def kwic_sort_1r(spark, d):
    return _out(kwic.ordered(_lines(spark, d), ["1R"]).limit(50))


@query(_ARR + 'SELECT doc_id, "left", node, "right", match_start, match_end FROM k ORDER BY doc_id, match_start LIMIT 20 OFFSET 10')
def kwic_page(spark, d):
    return _out(kwic.page(_lines(spark, d), 10, 20))


@query(_ARR + """SELECT doc_id, "left", node, "right", match_start, match_end FROM k WHERE contains(lower("right"), 'the')""")
def kwic_filtered(spark, d):
    return _out(kwic.Concordance(_lines(spark, d)).apply("filter_contains", column="right", text="The").rows)


@query(""", a AS (SELECT doc_id, list(word ORDER BY tok_idx) AS w FROM tok GROUP BY doc_id), f AS (SELECT doc_id, min(tok_idx) AS first_idx FROM tok WHERE word_lc='thing' GROUP BY doc_id)
SELECT doc_id, concat_ws(' ', array_to_string(w[greatest(1,first_idx-11):first_idx],' '), w[first_idx+1], array_to_string(w[first_idx+2:first_idx+13],' ')) AS snippet, first_idx FROM f JOIN a USING (doc_id)""")
def kwic_snippets(spark, d):
    c = corpus(spark, d)
    return kwic.snippet(c, plain.search(c, "thing")).withColumn("first_idx", F.col("first_idx").cast("long"))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])\s*') AS p FROM documents),
s AS (SELECT doc_id, list_transform(p, lambda x: regexp_replace(x, '\s+$', ' ')) AS s FROM p), k AS (SELECT doc_id, s, unnest(s) AS piece, generate_subscripts(s,1) AS i FROM s)
SELECT doc_id, rtrim(array_to_string(s[greatest(1,i-5):i-1],''),' ') AS "left", rtrim(piece,' ') AS node, rtrim(array_to_string(s[i+1:i+5],''),' ') AS "right" FROM k WHERE lower(rtrim(piece,' '))='thing'""", prelude=False)
def kwic_spaced(spark, d):
    """Lines spaced as in the source."""
    c = Corpus.from_documents(table(spark, d, "documents"), meta=[], spacing=True)
    return kwic.source_lines(c, plain.search(c, "thing")).select(*_KWIC)


@query()
def kwic_sample(spark, d):
    return _out(kwic.sample(_lines(spark, d), 20, seed=7))


_PII_SQL = "text"
for _name, _pattern_text in PII.items():
    _PII_SQL = f"regexp_replace({_PII_SQL}, '{_pattern_text}', '{_name}', 'g')"


@query(f"SELECT doc_id, md5({_PII_SQL}) AS digest FROM documents", prelude=False)
def pii_masked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(mask_pii(F.col("text")).cast("binary")).alias("digest"))


# -- ranking, pairs, vectors -----------------------------------------------------------

_TERMS = ", q AS (SELECT doc_id, count(*) FILTER (word='of')::DOUBLE AS a, count(*) FILTER (word='thing')::DOUBLE AS b FROM tok WHERE word IN ('of','thing') GROUP BY doc_id), g AS (SELECT count(*)::DOUBLE AS n, avg(n_tokens) AS al FROM docs), j AS (SELECT doc_id, a, b, n_tokens::DOUBLE AS len, n, al FROM q JOIN docs USING (doc_id), g) "


def _ranked(metric: str):
    def f(spark, d):
        return ranking.search_documents(corpus(spark, d), ["of", "thing"], metric, top_n=None).select("doc_id", *r6("score"))

    f.__name__ = f"docsearch_{metric.replace('-', '')}"
    return f


query(_TERMS + "SELECT doc_id, round(a+b,6) AS score FROM j WHERE a>0 AND b>0")(_ranked("tf"))
query(_TERMS + "SELECT doc_id, round((a+b)/len*ln(n/(1+df)),6)+0.0 AS score FROM j, (SELECT count(*)::DOUBLE AS df FROM j WHERE a>0 AND b>0) WHERE a>0 AND b>0")(_ranked("tf-idf"))
query(_TERMS + """SELECT doc_id, round(ln((n-da+0.5)/(da+0.5)+1)*a*2.5/(a+1.5*(0.25+0.75*len/al)) + ln((n-db+0.5)/(db+0.5)+1)*b*2.5/(b+1.5*(0.25+0.75*len/al)),6) AS score
FROM j, (SELECT count(*) FILTER (a>0)::DOUBLE AS da, count(*) FILTER (b>0)::DOUBLE AS db FROM j) WHERE a>0 AND b>0""")(_ranked("bm25"))


@query("SELECT conv_id, min(turn) FILTER (role='user') AS anchor_id, array_to_string(list_sort(list(turn) FILTER (role<>'user')),',') AS versions, count(*) AS size FROM conversations GROUP BY conv_id", prelude=False)
def pair_groups(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("doc_id"), "role")
    return pairs.groups(t, "conv_id", "role", "user").select("conv_id", "anchor_id", F.array_join("versions", ",").alias("versions"), "size")


@query()
def align_pairs(spark, d):
    """The anchor of each conversation, as in pair_groups, with each of its other turns."""
    found = pairs.versions(table(spark, d, "conversations"), "conv_id", "user")
    # dealt anew, so that a long conversation is not aligned in one task
    return pairs.align(found.repartition("pair_id", "version_id"), ("pair_id", "version_id"))


_ANN = "(SELECT event_id//3 AS row_id, event_id%3 AS coder, event_type AS category FROM events)"


def _annotations(spark, d):
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("row_id"), (F.col("event_id") % 3).alias("coder"), F.col("event_type").alias("category"))


@query(
    f"""WITH a AS {_ANN}, n AS (SELECT row_id, category, count(*)::DOUBLE AS n FROM a GROUP BY ALL), r AS (SELECT row_id, sum(n) AS k, sum(n*n) AS nn FROM n GROUP BY row_id HAVING sum(n) > 1),
pe AS (SELECT sum(p*p)/(sum(p)*sum(p)) AS pe FROM (SELECT sum(n) AS p FROM n WHERE row_id IN (SELECT row_id FROM r) GROUP BY category)), po AS (SELECT sum(nn-k)/sum(k*(k-1)) AS percent, avg((nn-k)/(k*(k-1))) AS pm FROM r)
SELECT 3::BIGINT AS n_coders, round(percent,6) AS percent, round((pm-pe)/(1-pe),6)+0.0 AS kappa, 'fleiss' AS kind FROM pe, po""",
    prelude=False,
)
def agreement_kappa(spark, d):
    return pairs.agreement(_annotations(spark, d)).select("n_coders", *r6("percent", "kappa"), "kind")


@query(
    f"""WITH a AS {_ANN}, x AS (SELECT l.row_id, l.category AS c1, r.category AS c2 FROM a l JOIN a r ON l.row_id=r.row_id AND l.coder<r.coder)
SELECT category, count(*) FILTER (c1=category AND c2=category) AS both_pairs, count(*) FILTER (c1=category OR c2=category) AS any_pairs, round(count(*) FILTER (c1=category AND c2=category)::DOUBLE/count(*) FILTER (c1=category OR c2=category),6) AS agreement
FROM x, (SELECT DISTINCT category FROM a) GROUP BY category""",
    prelude=False,
)
def agreement_pairs(spark, d):
    return pairs.category_agreement(_annotations(spark, d)).select("category", "both_pairs", "any_pairs", *r6("agreement"))


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id=0) SELECT vec_id, round(s,5) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 20""",
    prelude=False,
)
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(v, q, 20).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("SELECT label, i, round(avg(x),5)+0.0 AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings) GROUP BY label, i", prelude=False)
def centroids(spark, d):
    out = vectors.centroids(table(spark, d, "embeddings")).select("label", F.posexplode("centroid").alias("i", "x"))
    return out.select("label", F.col("i").cast("long").alias("i"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(
    """WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v),5)+0.0 AS similarity FROM c a JOIN c b ON a.label < b.label""",
    prelude=False,
)
def similarity_matrix(spark, d):
    out = vectors.similarity_matrix(vectors.centroids(table(spark, d, "embeddings")))
    return out.select("a", "b", (F.round("similarity", 5) + F.lit(0.0)).alias("similarity"))


@query(", x AS (SELECT doc_id%7 AS cluster, word_lc, count(*) AS n FROM tok WHERE is_word GROUP BY ALL) SELECT c.cluster, coalesce(label,'') AS label, c.size FROM (SELECT doc_id%7 AS cluster, count(*) AS size FROM documents GROUP BY ALL) c LEFT JOIN (SELECT cluster, arg_min(word_lc, (-n, word_lc)) AS label FROM x GROUP BY cluster) l ON l.cluster=c.cluster")
def cluster_labels(spark, d):
    c = corpus(spark, d)
    return vectors.cluster_labels(c, c.docs.select("doc_id", (F.col("doc_id") % 7).alias("cluster")))


@query()
def vector_clusters(spark, d):
    return vectors.cluster_all(table(spark, d, "embeddings"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocates of the node with every measure as displayed, best first."""
    rows = collocation.collocates(corpus(spark, sf_dir), NODE, 5, "s", min_freq=2)
    return collocation.displayed(collocation.ranked(rows, "logdice", 50)).select("collocate", "o11", "c1", "r1", "n", "fu", *measures.DISPLAY, "dice")

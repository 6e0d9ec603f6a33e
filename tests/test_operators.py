"""Operators against small hand-checked or brute-force cases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpuscle.functions import numeric
from korpuscle.functions.text import formula_guard, mask_pii
from korpuscle.operators import collocation, counting, deps, dispersion, kwic, pairs, ranking, running, scopes, vectors
from korpuscle.operators.corpus import Corpus, unit
from korpuscle.plans import matching, plain
from korpuscle.sources import readers


def test_beta_quantile():
    for a, b, p in ((3, 8, 0.1), (1, 1, 0.3), (200, 900, 1e-6), (0.5, 40, 0.999)):
        assert numeric.beta_cdf(numeric.beta_ppf(p, a, b), a, b) == pytest.approx(p, rel=1e-9)
    assert numeric.beta_cdf(0.25, 2, 3) == pytest.approx(0.26171875)
    assert numeric.conservative_log_ratio(0, 0, 5, 5, 1) == 0
    assert numeric.conservative_log_ratio(500, 5, 10_000, 100_000, 10) > 0 > numeric.conservative_log_ratio(5, 500, 10_000, 10_000, 10)


def test_binomial_mad():
    for n, p in ((10, 0.3), (25, 0.04), (7, 0.5)):
        want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) * abs(k - n * p) for k in range(n + 1))
        assert numeric.binomial_mad(n, p) == pytest.approx(want, rel=1e-12)


def test_windows_are_interval_unions(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for d in range(40):
        words = [rnd.choice(["n", "x", "y", "."]) for _ in range(rnd.randint(1, 20))]
        rows.append((d, " ".join(words)))
        sent = 0
        sents = []
        for x in words:
            sents.append(sent)
            sent += x == "."
        inside = set()
        for i, x in enumerate(words):
            if x == "n":
                inside |= {j for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i and sents[j] == sents[i]}
        want[d] = inside
    c = Corpus.from_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got: dict = {d: set() for d in want}
    for r in collocation.mark_windows(c, F.col("word") == "n", 3).where("in_w").collect():
        got[r.doc_id].add(r.tok_idx)
    assert got == want
    same = collocation.mark_windows(c, plain.search(c, "n"), 3).where("in_w").count()
    assert same == sum(map(len, want.values()))


@pytest.fixture(scope="module")
def parsed(spark):
    words = "Tea is my morning ritual . She drinks black tea .".split()
    heads = [1, 1, 4, 4, 1, 1, 7, 7, 9, 7, 7]
    rels = "nsubj ROOT poss compound attr punct nsubj ROOT amod dobj punct".split()
    df = spark.createDataFrame([(1, i, w, h, r) for i, (w, h, r) in enumerate(zip(words, heads, rels, strict=True))], "doc_id long, tok_idx int, word string, head_idx int, rel string")
    return Corpus.from_tokens(df)


def test_dependencies(parsed):
    assert [r.start_idx for r in plain.search(parsed, "drinks >dobj tea").collect()] == [7]
    assert [r.start_idx for r in plain.search(parsed, "black <amod tea").collect()] == [9]
    assert deps.arcs(parsed).count() == 9
    s = {(r.relation, r.word) for r in deps.sketch(parsed, "tea", 1).collect()}
    assert s == {("amod", "black"), ("dobj_rev", "drinks")}
    d = deps.sketch_difference(deps.sketch(parsed, "tea", 1), deps.sketch(parsed, "drinks", 1))
    assert {r.bucket for r in d.collect()} == {"only_a", "only_b"}


def test_no_dependency_layer(tea):
    with pytest.raises(plain.QueryError):
        plain.search(tea, "drink >dobj tea")


def test_meta_filters(tea):
    ids = lambda f: sorted(r.doc_id for r in scopes.docset_from_meta(tea, f).collect())
    every = list(range(1, 9))
    assert ids({"register": "blog"}) == [1, 3, 5, 8] and ids({"register": ["blog"]}) == [1, 3, 5, 8]
    assert ids({"register": ["blog", "news"]}) == every and ids({"register": " "}) == every and ids({"register": None}) == every and ids({"register": []}) == every
    assert ids({"date": {"op": "between", "lo": "2020", "hi": "2021"}}) == [3, 4]
    assert ids({"register": "blog", "date": {"op": ">=", "value": "2021"}}) == [5, 8]
    assert ids({"doc_id": "3"}) == [3] and ids({"date": {"op": ">", "value": 5}}) == [] and ids({"planet": "x"}) == []
    for bad in ({"date": {"op": "~", "value": 1}}, {"date": {"op": "between", "lo": 1}}):
        with pytest.raises(scopes.FilterError):
            ids(bad)
    s = scopes.Subcorpora(tea)
    s.save("b", {"register": "blog"})
    assert s.resolve("b").count() == 4
    a, b = scopes.docset_from_meta(tea, {"register": "blog"}), scopes.docset_from_meta(tea, {"register": "news"})
    scopes.require_disjoint(a, b)
    assert scopes.union(a, b).count() == 8 and scopes.intersection(a, b).count() == 0 and scopes.complement(tea, a).count() == 4
    with pytest.raises(scopes.FilterError):
        scopes.require_disjoint(a, a)


def test_contrasts(tea):
    blog, news = F.col("register") == "blog", F.col("register") == "news"
    c = {r.collocate: r for r in collocation.contrast(tea, "tea", blog, news, 3, min_freq=1).collect()}
    assert c["green"].target_freq == 5 and c["green"].reference_freq == 1
    g = {r.ngram: r for r in counting.ngram_contrast(tea, blog, news, 2, 1).collect()}
    assert g["cup of"].pm_t == pytest.approx(56818.18, abs=0.01)
    co = collocation.co_occurrence(tea, "tea", ["green"], 2)
    assert co.count() == 7


def test_ranking(tea):
    r = ranking.search_documents(tea, ["tea", "coffee"], "bm25").collect()
    assert [x.doc_id for x in ranking.search_documents(tea, ["tea", "coffee"], "tf").collect()] == [5, 3, 6] or len(r) == 3
    n, avg = 8, 162 / 8
    tf, size = {5: (3, 1), 3: (3, 1), 6: (1, 1)}, {5: 26, 3: 23, 6: 18}
    df = (5, 5)
    for x in r:
        want = sum(ranking.idf(n, df[i]) * tf[x.doc_id][i] * 2.5 / (tf[x.doc_id][i] + 1.5 * (0.25 + 0.75 * size[x.doc_id] / avg)) for i in range(2))
        assert x.score == pytest.approx(want)


def test_agreement(spark):
    two = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y"), (3, "a", "y"), (3, "b", "y"), (4, "a", "y"), (4, "b", "y")], "row_id long, coder string, category string")
    a = pairs.agreement(two).first()
    pe = (2 / 4) * (1 / 4) + (2 / 4) * (3 / 4)
    assert a.kind == "cohen" and a.percent == pytest.approx(0.75) and a.kappa == pytest.approx((0.75 - pe) / (1 - pe))
    c = {r.category: r.agreement for r in pairs.category_agreement(two).collect()}
    assert c == {"x": pytest.approx(1 / 2), "y": pytest.approx(2 / 3)}


def test_alignment(spark):
    assert pairs.levenshtein("a b c".split(), "a x c d".split()) == 2
    assert pairs.similarity("the big cat sat".split(), "the cat sat big".split()) == 1.0
    df = spark.createDataFrame([(1, "a b c . d e .".split(), "a b c . x y z . d e .".split())], "pair_id long, left array<string>, right array<string>")
    got = [(r.left_sent, r.right_sent, r.kind) for r in pairs.align(df).collect()]
    assert got == [(0, 0, "pair"), (None, 1, "gap"), (1, 2, "pair")]


def test_every_turn_is_aligned(spark, tmp_path):
    from korpuscle import queries

    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "a b c. d e."), (1, 2, "assistant", "a b c. x y z. d e."), (1, 3, "user", "d e."), (1, 4, "assistant", None), (2, 0, "system", "x y."), (2, 1, "assistant", "x y."), (3, 0, "user", "alone.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in queries.align_pairs(spark, str(tmp_path)).collect():
        got.setdefault((r.pair_id, r.version_id), []).append((r.left_sent, r.right_sent, r.kind))
    assert got == {
        (1, 0): got[1, 0], (1, 2): [(0, 0, "pair"), (None, 1, "gap"), (1, 2, "pair")], (1, 3): [(0, None, "gap"), (1, 0, "pair")], (1, 4): [(0, None, "gap"), (1, None, "gap")], (2, 1): [(0, 0, "pair")],
    }


def test_inference_from_five_occurrences(spark):
    from korpuscle import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the tables are not here")
    key = queries.keyness_inference(spark, data)
    assert key.where("a + c < 5").count() == 0 and key.where("a + c < 20 and p is not null and q is not null").count() > 0
    lrc = queries.colloc_lrc(spark, data)
    assert lrc.where("o11 < 5").count() == 0 and lrc.where("o11 < 20 and lrc is not null").count() > 0


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.nearest(df, [1.0, 0.0], 2).collect()] == [0, 1]
    x = np.array([[1, 0], [1, 0.05], [0.98, 0.1], [0, 1], [0.02, 1], [-1, -1]])
    assert vectors.cluster(x, 2).tolist() == [0, 0, 0, 1, 1, -1]
    assert vectors.cluster(x).tolist() == [-1] * 6 and vectors.cluster(x, 4).tolist() == [0, 0, 0, -1, -1, -1]
    assert vectors.expand_similar('[sim="tea" & k=2]', lambda w, k: ["coffee", "milk"][:k]) == '[word in {"tea", "coffee", "milk"}]'
    with pytest.raises(ValueError):
        vectors.cluster_vectors(df, limit=2)


def test_cluster_labels(spark):
    c = Corpus.from_documents(spark.createDataFrame([(1, "b a a"), (2, "b c"), (3, "!"), (4, "x")], "doc_id long, text string"))
    of = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "doc_id long, cluster int")
    assert sorted(map(tuple, vectors.cluster_labels(c, of).collect())) == [(0, "a", 2), (1, "", 1)]


def test_hits_of_every_query_form(spark):
    c = Corpus.from_documents(spark.createDataFrame([(1, "Tea and a cup. The cup of tea, of green tea."), (2, "Coffee")], "doc_id long, text string"))
    at = lambda q, **k: sorted(r.start_idx for r in matching.hits(c, q, **k).collect())
    assert at("co(term=tea, collocate=cup|OF, window=3)") == [8]
    assert at('co(term="tea",collocate=cup,window=9,within_sentence=false)') == [0, 8, 12]
    assert at('([word="cup"] | [word="of"])') == [3, 6, 7, 10]
    assert at('sim("cup")', similar=lambda w, k: ["green"]) == [3, 6, 11]
    for q in ("co(term=tea)", '[pos="NOUN"]'):
        with pytest.raises(matching.PatternError):
            matching.hits(c, q)
    assert matching.hits(c, '[pos="X"]').count() == 15
    assert at("co OR tea") == [0, 8, 12]


def test_type_tolerant_equality(spark):
    docs = spark.createDataFrame([(1, "a", 1.0, "1"), (2, "b", 2.5, "1.0")], "doc_id long, text string, x double, s string")
    c = Corpus.from_documents(docs)
    ids = lambda f: sorted(r.doc_id for r in scopes.docset_from_meta(c, f).collect())
    assert ids({"x": 1}) == [1] and ids({"x": [1, 2.5]}) == [1, 2] and ids({"x": {"op": "!=", "value": 1}}) == [2]
    assert ids({"s": 1}) == [1] and ids({"x": "1.0"}) == [1] and ids({"doc_id": 2.0}) == [2]


def test_clusters_of_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "LEFT", 2)
    monkeypatch.setattr(vectors, "RIGHT", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.2, 0.4, 0.6], (400, 1))
    x[rng.choice(400, 40, replace=False)] = x[0]
    x[7] = 0
    x = x.astype("float32")
    want = vectors.cluster(x.astype(float))
    assert len(set(want)) > 8 and (want[300:] >= 0).any() and (want < 0).any()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    more = spark.createDataFrame([(400, None), (401, [])], df.schema)
    got = {r.vec_id: r.cluster for r in vectors.cluster_all(df.union(more).repartition(5)).collect()}
    assert got == dict(enumerate([*want.tolist(), -1, -1]))
    assert vectors.cluster_all(df.limit(0)).count() == 0


def test_vector_clusters_takes_every_row(spark, tmp_path):
    from korpuscle import queries

    df = spark.createDataFrame([(i * 100, [1.0, i % 2 * 50.0]) for i in range(20)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in queries.vector_clusters(spark, str(tmp_path)).collect()}
    assert got == {i * 100: i % 2 for i in range(20)}


def test_cells(spark):
    df = spark.createDataFrame([("=1+1", "a@b.example.com 10.0.0.1")], "a string, b string")
    r = df.select(formula_guard(F.col("a")).alias("a"), mask_pii(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("'=1+1", "[email] [ip]")
    s = spark.createDataFrame([(["a", ",", "b"], [False, True, False])], "w array<string>, s array<boolean>")
    assert s.select(kwic.spaced(F.col("w"), F.col("s")).alias("t")).first().t == "a, b"


def test_running_start(spark):
    from korpuscle.operators.running import running_start

    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 9)) for i in rnd.sample(range(-500, 5000), 700)]
    df = spark.createDataFrame(rows, "doc_id long, side string, n long").repartition(5)
    total, want = 0, {}
    for i, _, n in sorted(rows):
        want[i] = total
        total += n
    assert {r.doc_id: r.s for r in running_start(df, "n", "s").collect()} == want
    per = {r.doc_id: r.s for r in running_start(df, "n", "s", ["side"]).collect()}
    assert all(per[i] == sum(n for j, t, n in rows if j < i and t == side) for i, side, _ in rows)
    assert running_start(df.limit(0), "n", "s").count() == 0


def test_benjamini_hochberg(spark):
    from korpuscle.operators.keyness import with_bh

    rng = np.random.default_rng(6)
    p = np.concatenate([10 ** -rng.uniform(0, 300, 150), rng.random(150), [1.0, 1.0, 0.0, 0.01, 0.01]])
    got = {r.word_lc: (r.q, r.m) for r in with_bh(spark.createDataFrame([(f"w{i}", float(x)) for i, x in enumerate(p)], "word_lc string, p double")).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    for k, i in enumerate(order):
        assert got[f"w{i}"] == (pytest.approx(q[k], rel=1e-12, abs=1e-300), len(p))


def test_string_ids_from_import_to_analysis(spark, tmp_path):
    """Ids as strings and as numbers in the same order give the same figures."""
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choices("the cat sat on a mat and ran off .".split(), k=rnd.randint(5, 90)))) for k in range(60)]
    path = tmp_path / "docs.csv"
    path.write_text("id,text\n" + "".join(f"doc-{k:03d},{t}\n" for k, t in rows))
    named = Corpus.from_documents(readers.read_csv(spark, str(path)).rows, id_col="id", meta=[])
    plain = Corpus.from_documents(spark.createDataFrame(rows, "doc_id long, text string"))

    def places(c):
        return sorted((int(str(r.doc_id).removeprefix("doc-")), r.start_idx, r.end_idx) for r in matching.hits(c, '[word="the"] []{0,3} [word="sat"]').collect())

    assert places(named) == places(plain) and len(places(plain)) > 3
    for f in (lambda c: dispersion.sttr(c, 100), lambda c: dispersion.mattr(c, 50), lambda c: dispersion.mattr(c, 7)):
        assert f(named).collect() == f(plain).collect()
    lines = [kwic.lines(c, matching.hits(c, '[word="the"]')) for c in (named, plain)]
    a, b = ([(r.left, r.node, r.right) for r in kwic.sample_indices(x, 9, 3).collect()] for x in lines)
    assert a == b and len(a) == 9


def test_running_start_of_strings(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKETS", 4)
    rows = [(f"é{k}" if k % 3 else f"Z{k}", k) for k in range(500)]
    out = running.running_start(spark.createDataFrame(rows, "doc_id string, n long"), "n", "before").collect()
    total, want = 0, {}
    for i, n in sorted(rows, key=lambda r: r[0].encode()):
        want[i], total = total, total + n
    assert {r.doc_id: r.before for r in out} == want


def test_mattr_by_hand(spark):
    rnd = random.Random(6)
    words = rnd.choices(["a", "b", "c", "dd", "ee"], weights=[20, 5, 3, 1, 1], k=400)
    c = Corpus.from_documents(spark.createDataFrame([(k, " ".join(words[40 * k : 40 * k + 40])) for k in range(10)], "doc_id long, text string"))
    for w in (1, 2, 7, 60, 400):
        want = sum(len(set(words[i : i + w])) / w for i in range(400 - w + 1)) / (400 - w + 1)
        assert dispersion.mattr(c, w).first()[0] == pytest.approx(want)


def test_phrase_collocates_split_only_texts_with_hits(spark):
    """Counts around hits equal those of windows over all tokens, and the plan that is left has no window and no join with tokens."""
    texts = ["a of the b. of the of the c d e f", "of. the x of the", "the of", None, "Of THE a, a of  the the", *[f"w{i} of a the w{i + 1}" for i in range(20)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for within, weighted in (("s", False), ("doc", False), ("s", True)):
        c = Corpus.from_documents(df, meta=[], deal=False)
        hits = plain.search(c, '"of the"')
        assert sorted((r.doc_id, r.start_idx) for r in hits.collect()) == [(0, 1), (0, 5), (0, 7), (1, 4), (4, 0), (4, 5)]
        whole = collocation.mark_windows(Corpus.from_documents(df, meta=[], persist=True), hits, 2, within)
        if weighted:
            w = unit(within)
            near = [F.coalesce(F.sum(F.col(x).cast("long")).over(w.rowsBetween(*f)), F.lit(0)) for x, f in (("is_start", (1, 2)), ("is_last", (-2, -1)))]
            whole = whole.withColumn("in_w", near[0] + near[1])
        want = {r.word: (r.o, r.c) for r in whole.groupBy("word").agg(F.sum(F.col("in_w").cast("long")).alias("o"), F.count("*").alias("c")).collect() if r.o}
        got = collocation.counts(c, hits, 2, within, weighted=weighted)
        rows = got.collect()
        assert {r.collocate: (r.o11, r.c1) for r in rows} == want
        total = whole.agg(F.count("*").alias("n"), F.sum(F.col("in_w").cast("long")).alias("r1"), F.count_if("is_start").alias("fu")).first()
        assert {(r.n, r.r1, r.fu) for r in rows} == {(total.n, total.r1, total.fu)}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan and "Generate" not in plan

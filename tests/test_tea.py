"""Published figures of the tea corpus."""

import pytest
from pyspark.sql import functions as F

from korpuscle.operators import collocation, counting, dispersion, keyness, kwic
from korpuscle.plans import matching


def rows(df):
    return [r.asDict() for r in df.collect()]


def hits(tea, q, **kw):
    return matching.hits(tea, q, **kw)


def test_sizes(tea):
    t = tea.totals().first()
    assert (t.n_docs, t.n_tokens, t.n_words) == (8, 162, 136)
    assert [r.n_tokens for r in tea.docs.orderBy("doc_id").collect()] == [24, 21, 23, 17, 26, 18, 14, 19]
    assert tea.tokens.select("doc_id", "sent_id").distinct().count() == 19


def test_frequency(tea):
    f = {r.key: r.freq for r in counting.frequency(tea).collect()}
    assert len(f) == 66
    assert [f[w] for w in ("tea", "coffee", "a", "green", "cup", "of", "is", "the")] == [17, 10, 8, 7, 6, 5, 5, 4]


@pytest.mark.parametrize(
    ("q", "kw", "n"),
    [("tea", {}, 17), ("Tea", {}, 17), ("Tea", {"case_sensitive": True}, 3), ('cql:[word="Tea"]', {}, 3), ('cql:[word="tea"%c]', {}, 17), ('cql:[word="green"%c] []{0,1} [word="tea"]', {}, 7), ('cql:[word="green"%c] []{0,4} [word="tea"]', {}, 6)],
)
def test_searches(tea, q, kw, n):
    assert hits(tea, q, **kw).count() == n


def test_gap_documents(tea):
    assert hits(tea, 'cql:[word="green"%c] []{0,1} [word="tea"]').select("doc_id").distinct().count() == 4


def test_collocations(tea):
    t = collocation.collocates(tea, "tea", 3, "s", with_lrc=True)
    r = {x["collocate"]: x for x in rows(collocation.displayed(t))}
    g = r["green"]
    assert (g["fu"], g["r1"], g["n"], g["o11"], g["c1"]) == (17, 74, 162, 6, 6)
    want = {
        "expected": 2.74, "mi": 1.1304, "mi3": 6.3003, "lmi": 6.7824, "npmi": 0.2377, "t": 1.33, "z": 1.9687, "chi2_cell": 3.88, "ll": 9.68, "logdice": 13.0614, "logdice_window": 11.2630,
        "delta_p_nc": 0.0811, "delta_p_cn": 0.5641, "log_ratio": 3.9504, "dice": 0.15, "lrc": 0.0,
    }
    for k, v in want.items():
        assert g[k] == pytest.approx(v, abs=1e-4), k
    for w in ("a", "is", "of"):
        assert (r[w]["o11"], r[w]["c1"], r[w]["mi"], r[w]["ll"], r[w]["logdice"]) == (4, 5, 0.8085, 2.56, 12.5406)
    assert (r["coffee"]["o11"], r["coffee"]["c1"], r["coffee"]["mi"], r["coffee"]["logdice"]) == (2, 7, -0.677, 11.4150)
    assert "tea" not in r and "Tea" not in r
    assert collocation.counts(tea, collocation.node_condition("tea"), 3, "doc").first().r1 == 77


def test_keyness(tea):
    k = {r["word_lc"]: r for r in rows(keyness.keyness(tea, F.col("register") == "blog", F.col("register") == "news"))}
    assert len(k) == 7
    t, a = k["tea"], k["a"]
    for got, want in (
        (t["ll"], 3.308754), (t["chi2"], 3.117638), (t["log_ratio"], 1.200819), (t["log_ratio_low"], -0.259143), (t["log_ratio_high"], 2.660781), (t["p"], 0.0689117), (t["q"], 0.0964764),
        (t["bic"], -1.603901), (a["ll"], 9.483044), (a["chi2"], 6.512987), (a["log_ratio"], 3.703319), (a["p"], 0.00207380), (a["q"], 0.01451657), (a["bic"], 4.570389), (a["lrc"], 0.0),
    ):
        assert got == pytest.approx(want, abs=1e-6)


def test_dispersion(tea):
    d = dispersion.dispersion(tea, hits(tea, "tea")).first().asDict()
    want = {"dp": 0.234568, "dpnorm": 0.256757, "vc": 0.640748, "juilland_d": 0.757820, "carroll_d2": 0.847494, "dp_min": 0.063907, "dp_expected": 0.25624, "dp_max": 0.91358}
    for k, v in want.items():
        assert d[k] == pytest.approx(v, abs=2e-6), k
    assert (d["range"], d["label"]) == (6, "fairly_even")
    c = dispersion.dispersion(tea, hits(tea, "coffee")).first()
    assert c.dp == pytest.approx(0.379012, abs=2e-6) and c.label == "fairly_clustered"
    none = dispersion.family(dispersion.profile(tea, hits(tea, "whisky"))).first()
    assert (none.hits, none.dp) == (0, 0.0)


def test_trend(tea):
    t = {r["period"]: r for r in rows(dispersion.trend(tea.docs, hits(tea, "tea"), "date"))}
    assert [(t[y]["n_hits"], t[y]["n_words"]) for y in ("2019", "2020", "2021", "2022")] == [(3, 39), (3, 34), (5, 36), (6, 27)]
    assert t["2019"]["per_million"] == pytest.approx(76923.08, abs=0.01)
    assert (t["2019"]["low"], t["2019"]["high"]) == (pytest.approx(26507.40, abs=0.01), pytest.approx(203210.71, abs=0.01))


def test_ngrams(tea):
    g = {r.ngram: r.freq for r in counting.ngrams(tea, 2).collect()}
    assert len(g) == 93
    assert [g[x] for x in ("green tea", "cup of", "of tea", "A cup", "I drink")] == [6, 5, 3, 3, 2]


def test_diversity(tea):
    d = dispersion.type_token(tea).first()
    assert (d.ttr, d.guiraud) == (pytest.approx(0.551471, abs=1e-6), pytest.approx(6.431197, abs=1e-6))
    s = dispersion.sttr(tea, 20).first()
    assert (s.windows, s.sttr) == (6, pytest.approx(0.9, abs=1e-9))
    assert dispersion.mattr(tea, 20).first().mattr == pytest.approx(0.891026, abs=1e-6)
    assert dispersion.mattr(tea, 500).first().mattr is None


def test_kwic(tea):
    k = kwic.lines(tea, hits(tea, '"cup of tea"'), 2)
    first = kwic.ordered(k, ["1L", "node"]).first()
    assert (first.left, first.node, first.right) == (". A", "cup of tea", "makes the")
    assert kwic.sample(k, 2, 1).collect() == kwic.sample(k, 2, 1).collect()
    assert kwic.sample_indices(k, 2, 1).count() == 2
    c = kwic.Concordance(k).apply("filter_contains", column="right", text="makes").apply("limit", n=5)
    assert c.rows.count() == 1 and [s[0] for s in c.steps] == ["filter_contains", "limit"]
    with pytest.raises(ValueError):
        kwic.sort_keys(["4L"])


def test_network(tea):
    e = collocation.network(tea, "tea", depth=2, nodes=10, window=3).collect()
    assert {x.source for x in e if x.depth == 1} == {"tea"} and len({frozenset((x.source, x.target)) for x in e}) == len(e)

"""Toxicity, quality rules, quality classifier: on texts whose labels follow a rule."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpuscle.llm import rff, rules, textstats, toxicity
from korpuscle.llm.common import id_hash_mod

from .helpers import EXTRA, awkward, empty, pairs

NO_LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(12)
    syllables = "ba ne ti ro lu sa mi ko de fa".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
    bad = ["vexogu", "drazhul", "krupnix"]
    docs, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rnd.randint(15, 150))]
        toxic, quality = int(rnd.random() < 0.3), int(rnd.random() < 0.7)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "", "s"]))
        text = " ".join(words)
        if not quality:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", "*** ")
        docs.append((i, text, 0.0, 1, 2))
        if i % 10:
            labels.append((i, quality, toxic))
    truth = {i: (q, t) for i, q, t in labels}
    return spark.createDataFrame(docs, EXTRA), spark.createDataFrame(labels, NO_LABELS), truth


def none(spark):
    return spark.createDataFrame([], NO_LABELS)


def test_folds(spark):
    ids = [0, 1, 12, 999, -5, 2**40, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for mod in (4, 5):
        got = {r.doc_id: r.m for r in df.select("doc_id", id_hash_mod("doc_id", mod).alias("m")).collect()}
        assert got == {i: None if i is None else zlib.crc32(str(i).encode()) % mod for i in ids}


def test_toxicity(spark, made):
    docs, labels, truth = made
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(out[i].predicted, t) for i, (_, t) in truth.items() if out[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.93
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, r in out.items() if not r.predicted)


def test_toxicity_awkward(spark, made):
    labels = made[1]
    odd = awkward(spark)
    assert toxicity.toxicity_scores(odd, none(spark)).count() == odd.count()
    assert {r.predicted for r in toxicity.toxicity_scores(odd, none(spark)).collect()} == {0}
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0
    both = made[0].unionByName(odd.where("doc_id is null or doc_id >= 40"))
    out = toxicity.toxicity_scores(both, labels)
    assert out.count() == both.count() and out.where("score is null").count() == 0


def test_toxicity_of_long_texts(spark):
    """Documents of 125,000 characters, half of them with one telling word, are learned from and told apart."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("ba ne ti ro lu sa mi ko de fa".split(), k=rnd.randint(1, 4))) for _ in range(3000)]
    rows = []
    for i in range(40):
        words = rnd.choices(vocabulary, k=21_000)
        if i % 2:
            words[rnd.randrange(len(words))] = "vexogu"
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(8)
    assert min(len(t) for _, t, _ in rows) > 100_000
    out = toxicity.toxicity_scores(df, spark.createDataFrame([(i, 0, y) for i, _, y in rows], NO_LABELS)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) == 40


def test_toxicity_copies_and_repeated_ids(spark):
    """A class of copies alone stays a class; rows that share an id are learned from once."""
    rows = [(i, "vexogu is a bad word to say here", 1) for i in range(30)] + [(100 + i, f"word{i} is a good thing to say here", 0) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zzz")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], NO_LABELS)
    model, rate = toxicity.fit_documents(df, labels)
    assert model is not None and 0 < rate < 1
    few = toxicity.sampled(df, labels, 5, 0, 10)
    assert Counter(r.y for r in few.collect()) == {0: 10, 1: 10} and few.select("doc_id").distinct().count() == 20
    assert sum(y for _, y in toxicity.unlike(few)) == 1
    one = toxicity.toxicity_scores(df, labels.where("toxic = 1")).collect()
    assert {(r.score, r.predicted) for r in one} == {(1.0, 1)}


def slow_score(model, text):
    """The highest window, word by word and number by number."""
    p, h = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN
    hard = lambda x: min(max(0.25 * x + 0.5, 0.0), 1.0)

    def vector(word):
        own = f"<{word}>"
        buckets = [((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) >> 9) % toxicity.TRIGRAMS for a, b, c in zip(own, own[1:], own[2:], strict=False)] if word else []
        chars = sum(p["tri"][k] for k in buckets) / len(buckets) if buckets else np.zeros(toxicity.DIM)
        return np.concatenate([p["words"][model.vocabulary.get(word, 1) if word else 0], chars])

    def read(vectors, d):
        state, out = np.zeros(h), []
        for x in vectors:
            g, m = x @ p["wx"][d] + p["b"][d, 0], state @ p["u"][d]
            z, r = [np.array([hard(v) for v in (g + m)[k * h : (k + 1) * h]]) for k in (0, 1)]
            c = np.tanh(g[2 * h :] + r * m[2 * h :])
            state = (1 - z) * c + z * state
            out.append(state)
        return out

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    step = toxicity.STRIDE
    starts = [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, step), len(words) - toxicity.WINDOW]
    best = -np.inf
    for s in starts:
        window = words[s : s + toxicity.WINDOW]
        window = window + [""] * (toxicity.WINDOW - len(window))
        vectors = [vector(w) for w in window]
        both = [np.concatenate(x) for x in zip(read(vectors, 0), read(vectors[::-1], 1)[::-1], strict=True)]
        e = np.array([np.tanh(b @ p["wa"]) @ p["va"] if w else -1e4 for b, w in zip(both, window, strict=True)])
        w = np.exp(e - e.max())
        best = max(best, float((w / w.sum()) @ np.array(both) @ p["wo"] + p["bo"][0]))
    return best


def test_scorer_is_the_slow_one():
    rnd = random.Random(4)
    model = toxicity.Model(["ba", "nero", "ti"], np.array([0.4, -0.2, 0.9]))
    texts = [None, "", "x", "ba nero", "ÄÖ ß 中文 😀 İΣ x1y_z"] + [" ".join(rnd.choices(["ba", "nero", "ti", "luba", "é", "Zz"], k=k)) for k in (39, 40, 41, 60, 61, 230)]
    got = toxicity.Scorer(model).documents(texts)
    assert got == pytest.approx([slow_score(model, t) for t in texts], abs=2e-5)


def test_windows_cover_all_words():
    for n in (0, 1, 39, 40, 41, 59, 60, 61, 200, 1234):
        s = toxicity.window_starts(n)
        seen = {i for a in s for i in range(a, min(a + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and (np.diff(s) <= toxicity.STRIDE).all()


def test_trigrams():
    flat, sizes = toxicity.trigrams(["", "a", "bcd", "", "a"])
    assert sizes.tolist() == [0, 1, 3, 0, 1] and len(flat) == 5 and flat[0] == flat[-1] and flat.max() < toxicity.TRIGRAMS
    assert flat[1:4].tolist() == toxicity.trigrams(["bcd"])[0].tolist() and len(toxicity.trigrams([""])[0]) == 0


def test_gradients():
    m = toxicity.Model(["a", "b", "c"], np.array([0.1, -0.2, 0.3]))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    words, ids = ["", "a", "b", "zz"], np.array([0, 2, 3, 1])
    windows = rng.integers(0, 4, (6, toxicity.WINDOW))
    windows[:, 0] = 1
    y = np.array([0, 1, 0, 1, 1, 0], float)

    def loss():
        logit = m.run(m.projected(m.inputs(words, ids)), windows)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    before = {k: v.copy() for k, v in m.p.items()}
    grads = {}
    m.step(words, ids, windows, y, moments := {}, 0)
    for k, (first, _) in moments.items():
        grads[k] = first * 10  # the first moment after one step is a tenth of the gradient
    m.p = before
    for name, at in (("u", (0, 1, 2)), ("u", (1, 3, 20)), ("wx", (1, 2, 9)), ("wa", (3, 1)), ("va", (2,)), ("words", (2, 1)), ("b", (0, 0, 17)), ("tri", (int(toxicity.trigrams(["zz"])[0][0]), 3))):
        eps = 1e-3
        old = m.p[name][at]
        m.p[name][at] = old + eps
        up = loss()
        m.p[name][at] = old - eps
        down = loss()
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.03, abs=2e-5), name


def slow_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(inside)


def test_counts():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a ", "b ", "c\n", "#", "é*", "\t", "\x85", "\x1c", "d\x0b"]) for _ in range(rnd.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), slow_repeats(words))
        assert textstats.text_stats(text)[:5] == want, repr(text)
    assert textstats.text_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_rules(spark, made):
    docs, labels, truth = made
    out = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    got = [(out[i].kept, bool(q)) for i, (q, _) in truth.items() if not out[i].base_failed]
    assert np.mean([a == b for a, b in got]) > 0.97
    assert all(not r.kept for r in out.values() if r.base_failed)
    named = docs.withColumn("korpuscle_n_words", F.lit("own"))
    kept = rules.keep_good(named, labels)
    assert kept.columns == named.columns and {r.korpuscle_n_words for r in kept.collect()} == {"own"}
    good = rules.keep_good(docs, labels)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, r in out.items() if r.kept)


def test_rules_awkward(spark, made):
    odd = awkward(spark)
    out = rules.quality_rules(odd, none(spark))
    assert out.count() == odd.count() and out.where("kept = base_failed").count() == 0
    assert rules.quality_rules(empty(spark), made[1]).count() == 0


def test_rule_list_is_its_expression(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 2))
    y = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 1] > 0.95)
    found = rules.learn(x, y, np.arange(600) % 3 == 0, ["a", "b"])
    assert 1 <= len(found) <= 6 and all(str(c) for r in found for c in r)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    kept = np.array([r.k for r in df.select(rules.verdict(found).alias("k")).collect()])
    rejected = np.any([rules.covered(r, x, ["a", "b"]) for r in found], axis=0)
    assert (kept == ~rejected).all() and np.mean(rejected == y) > 0.95


def test_quality(spark, made):
    docs, labels, truth = made
    out = {r.doc_id: r for r in rff.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in out.items())
    held = [(out[i].predicted, q) for i, (q, _) in truth.items() if out[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_awkward(spark, made):
    odd = awkward(spark)
    assert {r.score for r in rff.quality_scores(odd, none(spark)).collect()} == {0.5}
    assert rff.quality_scores(empty(spark), made[1]).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)], NO_LABELS)
    assert {r.score for r in rff.quality_scores(odd, one).collect()} == {1.0}
    both = made[0].unionByName(odd.where("doc_id is null or doc_id >= 40"))
    assert rff.quality_scores(both, made[1]).where("score between 0 and 1").count() == both.count()


def test_isotonic():
    r = rff.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1]))
    assert r.tolist() == [0.0, 1 / 3, 1 / 3, 1.0]


def test_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.random((50, len(textstats.RATIOS)))
    y, fold = rng.integers(0, 2, 50).astype(float), np.arange(50) % 2
    df = spark.createDataFrame([(*map(float, a), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], ", ".join(f"{c} double" for c in textstats.RATIOS) + ", y double, fold int").repartition(5)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    got = rff.normal_equations(df, mean, sd)
    z = rff.lift(x, mean, sd)
    for f in (0, 1):
        own = z[fold == f]
        assert np.allclose(got[f][0], own.T @ own) and np.allclose(got[f][1], own.T @ y[fold == f])


def test_kernel():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 8)) * 0.5
    z = rff.lift(x, np.zeros(8), np.ones(8))[:, 1:]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * rff.WIDTH**2 * 8))).mean() < 0.08


def test_pairs_helper(spark):
    assert pairs(empty(spark), "doc_id") == []

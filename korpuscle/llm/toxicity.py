"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are the lower-cased letter runs of a text. A word's input joins a learned vector of
the word with the mean of learned vectors of its character trigrams, so words never seen in learning
still count by their characters. The network reads windows of ``WINDOW`` words, half of which overlap
the next; attention weighs the states of both directions, and a document's score is that
of its highest window. Every window of every text is scored.

It is fitted on at most ``SAMPLE`` labelled documents of either class, those whose ids hash lowest, of any length. Their
texts stay on the executors: these count words, and pick up to ``TOP`` + ``CHANCE`` windows of
each document to learn from, those with the words most bound to the label and some by chance; the driver gets
counts and picked windows. After ``MINE`` steps the executors add the ``HARD`` windows of each document that the network
itself holds for the most toxic. Labels belong to documents, so of a toxic document's windows first the one with the most bound
words, then, by the network itself, the highest ones are learned as toxic. The cut between
the classes comes from the highest of all windows of each sampled document, scored on the executors.

Of sampled documents with one label that share one of two least hashes of their word 4-grams (copies, near copies), the
first by id hash is learned from, so that a group of copies does not outweigh the rest; both classes stay.
Of rows with one id, that with the least text is learned from.

Defined cases: a null or empty text is one window of padding and gets its score; a very long text is
scored whole, its windows a few thousand at a time; equal windows give equal scores, of equally high ones the first is learned; labels of
one class give every text that class; no labels 0; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of, cut, id_hash_mod, labelled, to_batch

#: Most labelled documents of either class in the sample.
SAMPLE = 1200
#: Windows of a sampled document that are learned from: with the strongest words, by chance, and, from step MINE on, the highest.
TOP, CHANCE, HARD, MINE = 8, 8, 4, 60
#: In learning a longer word stands by its first letters, which bounds what the driver gets; scoring reads it whole.
LETTERS = 64
WINDOW, STRIDE, HIDDEN = 40, 20, 8
#: Known words, buckets of trigrams, and the width of their vectors.
WORDS, TRIGRAMS, DIM = 4000, 2048, 8
STEPS, BATCH, RATE, SEED = 180, 128, 0.02, 11
#: Steps after which the windows are chosen anew; share of known words read by their characters alone in a step.
RECHOOSE, DROP = 60, 0.35
#: Largest share of a toxic window's words that give way to words of other texts in a step.
MIX = 0.6
#: Windows run at once; words a task remembers.
AT_ONCE, REMEMBER = 1024, 300_000
find_words = re.compile(r"[^\W\d_]+").findall
F32 = np.float32


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, between ``<`` and ``>``, end to end, and how many are each word's; the empty word has none."""
    sizes = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join([f"<{w}>" for w in words if w]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.int64), sizes
    mixed = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes[sizes > 0] + 2)
    inside[ends - 1] = inside[ends - 2] = False  # a trigram starts at neither of a word's last two places
    return ((mixed >> np.uint64(9)) % np.uint64(TRIGRAMS)).astype(np.int64)[inside[:-2]], sizes


def window_starts(n: int) -> np.ndarray:
    """Starts of all overlapping windows; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def windows_of(ids: np.ndarray) -> np.ndarray:
    if len(ids) < WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None, :]
    return ids[window_starts(len(ids))[:, None] + np.arange(WINDOW)]


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * F32(0.25) + F32(0.5), 0, 1)


class Model:
    """Parameters, with Adam's moments while it learns."""

    def __init__(self, vocabulary: list[str], odds: np.ndarray):
        rng = np.random.default_rng(SEED)
        h, d = HIDDEN, 2 * DIM
        init = lambda *s, k=0.3: rng.normal(0, k, s).astype(F32)
        self.vocabulary = {w: i + 2 for i, w in enumerate(vocabulary)}  # 0: padding, 1: any other
        self.p = {
            "words": init(len(vocabulary) + 2, DIM, k=0.1), "tri": init(TRIGRAMS, DIM, k=0.1), "wx": init(2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), F32),
            "u": init(2, h, 3 * h), "wa": init(2 * h, h), "va": init(h), "wo": init(2 * h), "bo": np.zeros(1, F32),
        }
        self.p["words"][2:, 0] += odds.astype(F32)
        self.shift = 0.0

    def inputs(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """Input vectors of words; the empty word is padding."""
        chars = np.zeros((len(words), DIM), self.p["tri"].dtype)
        flat, sizes = trigrams(words)
        has = sizes > 0
        if len(flat):
            chars[has] = np.add.reduceat(self.p["tri"][flat], (np.cumsum(sizes) - sizes)[has], axis=0) / sizes[has, None].astype(F32)
        return np.hstack([self.p["words"][ids], chars])

    def projected(self, x: np.ndarray) -> np.ndarray:
        """[2, words, 3 hidden]: what a word adds to the gates of either direction."""
        return x @ self.p["wx"] + self.p["b"]

    def run(self, table: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows of rows of ``table``; keep gets what learning needs."""
        h, n = HIDDEN, len(windows)
        u = self.p["u"]
        state = np.zeros((2, n, h), F32)
        states = np.zeros((2, WINDOW, n, h), F32)
        order = np.ascontiguousarray(windows.T)
        g = np.empty((2, n, 3 * h), F32)
        for t in range(WINDOW):
            np.take(table[0], order[t], axis=0, out=g[0])
            np.take(table[1], order[WINDOW - 1 - t], axis=0, out=g[1])
            m = state @ u
            zr_in = g[:, :, : 2 * h] + m[:, :, : 2 * h]
            zr = gate(zr_in)
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(g[:, :, 2 * h :] + r * m[:, :, 2 * h :])
            if keep is not None:
                keep.append((state, m[:, :, 2 * h :].copy(), zr_in, zr, c))
            state = c + z * (state - c)
            states[0, t], states[1, WINDOW - 1 - t] = state[0], state[1]
        both = np.concatenate([states[0], states[1]], axis=2)  # [time, n, 2h]
        a = np.tanh(both @ self.p["wa"])
        e = np.where(order > 0, a @ self.p["va"], F32(-1e4))
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", w, both)
        if keep is not None:
            keep.append((both, a, w, pooled))
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def step(self, words: list[str], ids: np.ndarray, windows: np.ndarray, y: np.ndarray, moments: dict, k: int) -> float:
        """One step of Adam on the cross entropy of windows of the given distinct words."""
        h, n, p = HIDDEN, len(windows), self.p
        x = self.inputs(words, ids)
        table = self.projected(x)
        keep: list = []
        logit = self.run(table, windows, keep)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g_logit = ((prob - y) / n).astype(F32)
        both, a, w, pooled = keep.pop()
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        grad["wo"], grad["bo"] = pooled.T @ g_logit, np.array([g_logit.sum()], F32)
        g_pooled = g_logit[:, None] * p["wo"]
        g_w = np.einsum("nk,tnk->tn", g_pooled, both)
        g_e = w * (g_w - (w * g_w).sum(axis=0))
        g_a = g_e[:, :, None] * p["va"] * (1 - a * a)
        grad["va"] = np.einsum("tn,tnk->k", g_e, a)
        grad["wa"] = np.einsum("tnk,tnj->kj", both, g_a)
        g_both = w[:, :, None] * g_pooled + g_a @ p["wa"].T
        g_table = np.zeros_like(table)
        carry = np.zeros((2, n, h), F32)
        order = windows.T
        for t in range(WINDOW - 1, -1, -1):
            before, mn, zr_in, zr, c = keep[t]
            carry = carry + np.stack([g_both[t, :, :h], g_both[WINDOW - 1 - t, :, h:]])
            z, r = zr[:, :, :h], zr[:, :, h:]
            g_c = carry * (1 - z) * (1 - c * c)
            g_zr = np.concatenate([carry * (before - c), g_c * mn], axis=2) * F32(0.25) * (np.abs(zr_in) < 2)
            g_m = np.concatenate([g_zr, g_c * r], axis=2)
            g_g = np.concatenate([g_zr, g_c], axis=2)
            np.add.at(g_table[0], order[t], g_g[0])
            np.add.at(g_table[1], order[WINDOW - 1 - t], g_g[1])
            grad["u"] += np.swapaxes(before, 1, 2) @ g_m
            carry = carry * z + g_m @ np.swapaxes(p["u"], 1, 2)
        grad["wx"] = x.T @ g_table
        grad["b"] = g_table.sum(axis=1, keepdims=True)
        g_x = (g_table @ np.swapaxes(p["wx"], 1, 2)).sum(axis=0)
        np.add.at(grad["words"], ids, g_x[:, :DIM])
        flat, sizes = trigrams(words)
        np.add.at(grad["tri"], flat, np.repeat(g_x[:, DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        for name, g in grad.items():
            m, v = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += F32(0.1) * (g - m)
            v += F32(0.001) * (g * g - v)
            p[name] -= F32(RATE) * (m / F32(1 - 0.9 ** (k + 1))) / (np.sqrt(v / F32(1 - 0.999 ** (k + 1))) + F32(1e-7))
        return float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))


class Scorer:
    """Scores texts in a worker: words become rows of a table of projected inputs."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.table = np.zeros((2, 1024, 3 * HIDDEN), F32)
        self.table[:, :1] = self.model.projected(self.model.inputs([""], np.zeros(1, np.int64)))

    def add(self, words: list[str]) -> None:
        first, n = len(self.rows), len(words)
        while first + n > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        ids = np.array([self.model.vocabulary.get(w, 1) for w in words])
        self.table[:, first : first + n] = self.model.projected(self.model.inputs(words, ids))
        self.rows.update(zip(words, range(first, first + n), strict=True))

    def rows_of(self, text: str | None) -> np.ndarray:
        words = find_words((text or "").lower())
        found = list(map(self.rows.get, words))
        if None in found:
            self.add(sorted({w for w, i in zip(words, found, strict=True) if i is None}))
            found = list(map(self.rows.get, words))
        return np.array(found, np.int64)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.model.run(self.table, windows[i : i + AT_ONCE]) for i in range(0, len(windows), AT_ONCE)])

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text; windows of several texts run together."""
        out = np.full(len(texts), -np.inf)
        wait: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            if wait:
                np.maximum.at(out, np.concatenate(owner), self.logits(np.concatenate(wait)))
            wait.clear()
            owner.clear()
            held = 0

        for i, text in enumerate(texts):
            if len(self.rows) > REMEMBER:
                flush()
                self.clear()
            w = windows_of(self.rows_of(text))
            wait.append(w)
            owner.append(np.full(len(w), i))
            held += len(w)
            if held >= 8 * AT_ONCE:
                flush()
        flush()
        return out


# -- learning --------------------------------------------------------------------------


def learning_words(text: str | None) -> list[str]:
    return [w[:LETTERS] for w in find_words((text or "").lower())]


def signs(words: list[str]) -> tuple[int, int]:
    """Two least hashes of the 4-grams of a text."""
    grams = np.array([zlib.crc32(" ".join(words[j : j + 4]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(words) - 3))], np.uint64)
    return int(grams.min()), int((grams * np.uint64(2_654_435_761) % np.uint64(1 << 32)).min())


def sampled(docs: DataFrame, labels: DataFrame, mod: int, held: int, sample: int) -> DataFrame:
    """(doc_id, y, h, text): at most ``sample`` labelled documents of either class, written to the checkpoint folder."""
    known = labelled(labels, "toxic").where(id_hash_mod("doc_id", mod) != held).withColumn("h", F.xxhash64("doc_id"))
    part = None
    for c in (0, 1):  # at most 2 x sample ids
        own = known.where(F.col("y") == c).orderBy("h", "doc_id").limit(sample)
        part = own if part is None else part.unionByName(own)
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(few.join(F.broadcast(part), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text")))


def unlike(few: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, y) of the documents less copies with the same label; at most the sample's size."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            yield to_batch(schema, [(i, y, h, *signs(learning_words(t))) for i, y, h, t in zip(*columns_of(batch, "doc_id", "y", "h", "text"), strict=True)])

    seen, out = set(), []
    for r in sorted(few.mapInArrow(run, "doc_id long, y int, h long, a long, b long").collect(), key=lambda r: (r.h, r.doc_id)):
        own = {(r.y, 0, r.a), (r.y, 1, r.b)}
        if not own & seen:
            out.append((r.doc_id, r.y))
            seen |= own
    return out


def bound_words(few: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """The ``WORDS`` words in more than two documents whose log-odds are the most standard errors from none, with that number."""
    schema = pa.schema([("word", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            out = [(w, seen[0][w], seen[1][w]) for w in seen[0].keys() | seen[1].keys()]
            for c in seen:
                c.clear()
            return to_batch(schema, out)

        for batch in batches:
            for y, text in zip(*columns_of(batch, "y", "text"), strict=True):
                seen[y].update({w for w in learning_words(text) if len(w) < LETTERS})
                if len(seen[0]) + len(seen[1]) > REMEMBER:
                    yield rows()
        yield rows()

    found = few.mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("b"), F.sum("n1").alias("a")).where("a + b > 2")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = F.lit(float(n1)) - F.col("a") + 0.5, F.lit(float(n0)) - F.col("b") + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {r.word: r.z for r in found.select("word", z.alias("z")).orderBy(F.abs("z").desc(), "word").limit(WORDS).collect()}


def picked_windows(few: DataFrame, bound: dict[str, float], least: float) -> list[tuple[int, int, list[list[str]]]]:
    """(doc_id, y, windows) of each document, in the order of ids: the strongest windows, then some by chance."""
    strong = few.sparkSession.sparkContext.broadcast({w: v - least for w, v in bound.items() if v > least})
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("windows", pa.list_(pa.string()))])

    def run(batches):
        get = strong.value.get
        for batch in batches:
            rows = []
            for doc_id, y, text in zip(*columns_of(batch, "doc_id", "y", "text"), strict=True):
                words = learning_words(text)
                starts = window_starts(len(words))
                sums = np.concatenate([[0.0], np.cumsum([get(w, 0.0) for w in words])])
                worth = sums[np.minimum(starts + WINDOW, len(words))] - sums[starts]
                top = np.argsort(-worth, kind="stable")[:TOP]
                rest = np.setdiff1d(np.arange(len(starts)), top)
                by_chance = np.random.default_rng([SEED, doc_id & (2**63 - 1)]).permutation(rest)[:CHANCE]
                rows.append((doc_id, y, [" ".join(words[i : i + WINDOW]) for i in starts[np.concatenate([top, by_chance])]]))
            yield to_batch(schema, rows)

    got = few.mapInArrow(run, "doc_id long, y int, windows array<string>").collect()
    return [(r.doc_id, r.y, [w.split() for w in r.windows]) for r in sorted(got, key=lambda r: r.doc_id)]


def hard_windows(few: DataFrame, model: Model) -> dict[int, list[list[str]]]:
    """The highest windows of each document, by the network, by doc_id."""
    sent = few.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("windows", pa.list_(pa.string()))])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                words = learning_words(text)
                if len(scorer.rows) > REMEMBER:
                    scorer.clear()
                top = np.argsort(-scorer.logits(windows_of(scorer.rows_of(text))), kind="stable")[:HARD]
                rows.append((doc_id, [" ".join(words[i : i + WINDOW]) for i in window_starts(len(words))[top]]))
            yield to_batch(schema, rows)

    return {r.doc_id: [w.split() for w in r.windows] for r in few.mapInArrow(run, "doc_id long, windows array<string>").collect()}


def new_model(bound: dict[str, float], start: bool = True) -> Model:
    return Model(list(bound), np.array([np.clip(v / 8, -1, 1) if start else 0.0 for v in bound.values()]))


def fit(model: Model, moments: dict, chosen: list[tuple[int, list[list[str]]]], bound: dict[str, float], least: float, steps: range) -> None:
    """Steps of learning on documents' labels and windows; step 0 chooses by the bound words, later ones by the network."""
    labels = np.array([y for y, _ in chosen], bool)
    rng = np.random.default_rng([SEED, steps.start])
    kinds = {"": 0} | {w: i + 1 for i, w in enumerate(sorted({w for _, ws in chosen for x in ws for w in x}))}
    names = list(kinds)
    known = np.array([model.vocabulary.get(w, 1) if w else 0 for w in names])
    strength = np.array([max(0.0, bound.get(w, 0.0) - least) for w in names])
    all_windows = [np.array([[kinds[w] for w in x] + [0] * (WINDOW - len(x)) for x in ws], np.int64) for _, ws in chosen]
    first = [strength[w].sum(axis=1) for w in all_windows]

    def choose(score: list[np.ndarray], least: float, near: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Toxic are, of each toxic text whose highest window is above ``least``, that and those with bound words at most ``near`` below it. Not toxic are
        the highest window of other texts, one by chance, and the lowest of a toxic text that has no bound word, lest its other words stand for the label."""
        toxic, clean = [], [np.zeros((4, WINDOW), np.int64)]
        for w, s, f, t in zip(all_windows, score, first, labels, strict=True):
            if not t:
                clean.append(w[[int(s.argmax()), int(rng.integers(len(w)))]])
            elif s.max() > least:
                close = (s >= s.max() - near) & (f > 0)
                close[int(s.argmax())] = True
                toxic.append(w[close])
                low = int(s.argmin())
                if s[low] <= least and not f[low]:
                    clean.append(w[[low]])
        return toxic, np.concatenate(clean)

    def choose_by_network() -> tuple[list[np.ndarray], np.ndarray]:
        return choose(document_logits(model, names, known, all_windows), -1.0, 3.0)

    def batch() -> np.ndarray:
        """Half toxic windows, of documents and then of their windows by chance, half others; some words without a bond to the
        label give way to words of other texts, lest a few windows be learned by heart."""
        no = clean[rng.integers(len(clean), size=BATCH // 2)]
        if not toxic:
            return no
        yes = np.stack([toxic[i][rng.integers(len(toxic[i]))] for i in rng.integers(len(toxic), size=BATCH // 2)])
        mixed = (rng.random(yes.shape) < MIX * rng.random((len(yes), 1))) & weak[yes] & (yes > 0)
        other = pool[rng.integers(len(pool), size=yes.shape)]
        return np.concatenate([no, np.where(mixed, other, yes)])

    weak = np.array([bound.get(w, 0.0) < 1 for w in names])
    pool = np.concatenate([w[w > 0] for w, t in zip(all_windows, labels, strict=True) if not t] + [np.zeros(1, np.int64)])
    toxic, clean = choose(first, 0.0, 1.0)
    if not toxic:
        toxic, clean = choose(first, -1.0, 1.0)
    for k in steps:
        if k and (k % RECHOOSE == 0 or k == steps.start):
            toxic, clean = choose_by_network()
        x = batch()
        used, inverse = np.unique(x, return_inverse=True)
        if used[0] != 0:
            used, inverse = np.concatenate([[0], used]), inverse + 1
        # row 0 is padding, as everywhere
        ids = np.where((rng.random(len(used)) < DROP) & (known[used] > 1), 1, known[used])
        model.step([names[i] for i in used], ids, inverse.reshape(x.shape), (np.arange(len(x)) >= BATCH // 2).astype(F32), moments, k)


def document_logits(model: Model, names: list[str], known: np.ndarray, all_windows: list[np.ndarray]) -> list[np.ndarray]:
    table = model.projected(model.inputs(names, known))
    flat = np.concatenate(all_windows)
    out = np.concatenate([model.run(table, flat[i : i + AT_ONCE]) for i in range(0, len(flat), AT_ONCE)])
    return np.split(out, np.cumsum([len(w) for w in all_windows])[:-1])


def highest(few: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Labels and highest logits of the sampled documents, over all their windows."""
    sent = few.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            y, texts = columns_of(batch, "y", "text")
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(scorer.documents(texts))], names=["y", "top"])

    rows = few.mapInArrow(run, "y int, top double").collect()
    return np.array([r.y for r in rows], bool), np.array([r.top for r in rows])


def middle(labels: np.ndarray, top: np.ndarray) -> float:
    """Of the cuts that get most documents right, both classes weighing the same, or all but a 400th of that, the one in the widest gap."""
    order = np.lexsort((labels, top))
    own = labels[order]
    right = np.concatenate([[0], np.cumsum(np.where(own, -1 / max(1, own.sum()), 1 / max(1, (~own).sum())))])
    near = np.flatnonzero(right >= right.max() - 1 / 400)
    ends = np.concatenate([[top.min() - 1], top[order], [top.max() + 1]])
    k = int(near[np.argmax(ends[near + 1] - ends[near])])
    return float((ends[k] + ends[k + 1]) / 2)


def fit_documents(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, sample: int = SAMPLE, steps: int = STEPS, start: bool = True) -> tuple[Model | None, float]:
    """The model, and the rate of label 1 in the sample, which stands for a model where one class is missing."""
    bounded_batches(docs.sparkSession, 50)
    few = sampled(docs, labels, mod, held, sample)
    own = unlike(few)
    n1 = sum(y for _, y in own)
    if not 0 < n1 < len(own):
        return None, float(n1 > 0)
    few = few.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i, _ in own], "doc_id long")), "doc_id")
    bound = bound_words(few, len(own) - n1, n1)
    least = min(3.0, 0.75 * max(bound.values(), default=0.0))
    model, moments, picked = new_model(bound, start), {}, picked_windows(few, bound, least)
    fit(model, moments, [(y, w) for _, y, w in picked], bound, least, range(0, min(MINE, steps)))
    if steps > MINE:
        more = hard_windows(few, model)
        fit(model, moments, [(y, w + [x for x in more.get(i, []) if x not in w]) for i, y, w in picked], bound, least, range(MINE, steps))
    model.shift = middle(*highest(few, model))
    return model, n1 / len(own)


def probabilities(scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    raw = scorer.documents(texts) - scorer.model.shift
    return np.round(1 / (1 + np.exp(-np.clip(raw, -30, 30))), 6)


def keep_clean(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    spark = docs.sparkSession
    model, rate = fit_documents(docs, labels, mod, held)
    if model is None:
        return docs.where(F.lit(rate != 1))
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(probabilities(scorer, batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Labels of ids whose crc32 modulo ``mod`` is ``held`` are not learned from.
    """
    spark = docs.sparkSession
    model, rate = fit_documents(docs, labels, mod, held)
    held_out = F.coalesce(id_hash_mod("doc_id", mod) == held, F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    if model is None:
        one = 1.0 if rate == 1 else 0.0
        return narrow.select("doc_id", "held_out", F.lit(one).alias("score"), F.lit(int(one >= threshold)).alias("predicted"))
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            doc, texts, held_col = columns_of(batch, "doc_id", "text", "held_out")
            p = probabilities(scorer, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(held_col, pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

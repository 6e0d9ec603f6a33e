import random
import re

import numpy as np
import xxhash

from korpuscle.llm import components, simhash

from .helpers import awkward, empty, pairs


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, threshold=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (x >> 63 << 64)


def test_fingerprint():
    for text in (None, "", "A", "a B", "a b c", "The the THE the the", "x y z w v u", "é ß\x85q w"):
        assert simhash.fingerprint(text) == slow_print(text), text


def test_every_linked_pair_meets_at_an_anchor():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x = int(rnd.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rnd.choice(64, rnd.integers(0, 3), replace=False):
            y ^= 1 << int(b)
        a, f = simhash.replicas(np.array([signed(x), signed(y)], "<i8"))
        assert set(a[f == signed(x)]) & set(a[f == signed(y)])
        assert len(a) <= 64 and all(simhash.syndrome(a.astype(np.uint32) & np.uint32(0x7FFFFFFF)) == 0)


def clustered(rnd, n):
    out = []
    for _ in range(n):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            out.append(x)
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
    return out


def test_links_give_all_components(spark):
    prints = list(dict.fromkeys(clustered(random.Random(3), 150)))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(5)
    found = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    want = slow_components(prints)
    got = [found.get(signed(p), signed(p)) for p in prints]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_large_anchors_take_the_other_way(monkeypatch):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = np.unique(np.array([signed(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))) for _ in range(400)], "<i8"))
    few = simhash.local_links(fps, 2)
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", 10)
    many = simhash.local_links(fps, 2)
    assert len(few) == len(many) and {a for a, _ in few} == {a for a, _ in many}


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    df = awkward(spark)
    rows = df.collect()
    prints = [slow_print(r.text) for r in rows]
    comp = slow_components(prints)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, signed(p), least.get(c)) for r, p, c in zip(rows, prints, comp, strict=True)), key=repr)
    assert pairs(simhash.near_duplicates(df), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    rows = df.collect()
    comp = slow_components([slow_print(r.text) for r in rows])
    want = []
    for c in set(comp):
        own = [r.doc_id for r, k in zip(rows, comp, strict=True) if k == c]
        want.append(min((i for i in own if i is not None), default=None))
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_keep_one_returns_columns_of_its_own_name_as_they_were(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "a b c d", 8, "y"), (3, "e f g h", 9, "z")], "doc_id long, text string, korpuscle_row int, KORPUSCLE_row_ string")
    df.write.parquet(str(tmp_path / "d"))
    out = simhash.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d", 7, "x"), (3, "e f g h", 9, "z")]

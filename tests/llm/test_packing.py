import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from korpuscle.llm import packing

from .helpers import awkward, empty

BYTE = P.path("byte_bpe_50k.json")


def test_plan_holds_every_piece_once():
    rnd = random.Random(6)
    for capacity in (10, 100, 1024):
        counts = {n: rnd.randint(0, 50) for n in range(1, capacity + 1) if rnd.random() < 0.4}
        groups = packing.plan_bins(counts, capacity)
        got = Counter()
        for items, bins in groups:
            assert bins > 0 and sum(items) <= capacity and sum(3 * n > capacity for n in items) <= 2
            for n in items:
                got[n] += bins
        assert got == Counter({n: c for n, c in counts.items() if c})
        tokens, bins = sum(n * c for n, c in counts.items()), sum(b for _, b in groups)
        assert bins <= 1.25 * tokens / capacity + 1
    assert packing.plan_bins({}, 8) == []


def test_plan_is_tight_where_items_are_small():
    rnd = random.Random(7)
    counts = Counter(rnd.randint(1, 300) for _ in range(5000))
    bins = sum(b for _, b in packing.plan_bins(counts, 1024))
    assert bins == -(-sum(n * c for n, c in counts.items()) // 1024)


def test_large_pairs():
    assert sorted(map(lambda g: (sorted(g[0]), g[1]), packing.plan_bins({6: 2, 4: 2, 5: 3, 1: 1}, 10))) == [([1, 5], 1), ([4, 6], 2), ([5, 5], 1)]


def test_documents(spark):
    df = awkward(spark).repartition(3)
    lib = Tokenizer.from_file(BYTE)
    out = packing.pack_documents(df, BYTE, 2, 64)
    rows = out.collect()
    ids = Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in df.collect())
    want = Counter()
    for (doc, seq), k in ids.items():
        first = len(seq) if len(seq) <= 64 else len(seq) % 64 or 64
        at = 0
        for piece, size in enumerate([first] + [64] * ((len(seq) - first) // 64)):
            raw = np.array(seq[at : at + size], "<u4").tobytes()
            want[doc, piece, at, size, zlib.crc32(raw), raw] += k
            at += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark), BYTE, 2, 64).count() == 0

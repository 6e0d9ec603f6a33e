"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

EXTRA = "doc_id long, text string, score double, length long, row long"


def awkward(spark, seed=1, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ba", "ne", "ti", "ro", "lu"]) for _ in range(rnd.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    texts += [None, "", "   ", "\n\n", "x", texts[0], texts[0], texts[1] + " extra", "ÄÖ ß é 中文 İΣ́ \x00 \x85", " ".join(word() for _ in range(5000)), "y" * 3000]
    rows = [(i, t, 1.0, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", 1.0, 2, 3)]
    return spark.createDataFrame(rows, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)

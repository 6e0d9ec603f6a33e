"""The pipeline against its stages done by hand, and the guard of the entry module."""

import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from korpuscle.llm import packing, rules, simhash, textstats, toxicity

from .test_models import slow_repeats, slow_score

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_run_is_its_stages(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    kept = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 0").collect()}
    docs = docs.where(docs.doc_id.isin(list(kept)))
    kept &= {r.doc_id for r in rules.quality_rules(docs, labels).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(list(kept)))
    kept = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == kept
    want = packing.pack_documents(docs.where(docs.doc_id.isin(list(kept))), corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))
    assert len({r.sequence_id for r in got}) == want.select("sequence_id").distinct().count()


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_run_against_brute_force(spark):
    """Given the learned network and rules: every window, every count, every pair of fingerprints and every token."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model, rate = toxicity.fit_documents(docs, labels)
    kept = [i for i, t in texts.items() if (slow_score(model, t) < model.shift if model else rate != 1)]
    stats = {i: textstats.text_stats(texts[i]) for i in kept}
    few = docs.where(docs.doc_id.isin(kept))
    found = rules.fit_rules(textstats.document_stats(few), labels)
    names = list(textstats.RATIOS)

    def good(i):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        x = np.array([stats[i][len(textstats.COUNTS) :]])
        return len(words) >= 10 and 100 * slow_repeats(words) <= 20 * len(words) and not any(rules.covered(r, x, names)[0] for r in found)

    kept = sorted(filter(good, kept))
    prints = {i: slow_fingerprint(texts[i]) for i in kept}
    first = {i: i for i in kept}
    for _ in kept:  # the least id spreads over links until nothing changes
        new = {i: min(first[j] for j in kept if (prints[i] ^ prints[j]).bit_count() <= 2) for i in kept}
        if new == first:
            break
        first = new
    lib = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i in set(first.values()):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want) > 50
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/korpuscle", tmp_path / "korpuscle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_queries_are_there():
    names = entry.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)

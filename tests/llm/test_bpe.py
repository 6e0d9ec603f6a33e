import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from korpuscle.llm import bpe

from .helpers import awkward, empty, pairs

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_is_the_library(path):
    lib, rnd = Tokenizer.from_file(path), random.Random(2)
    for leaf in (2, 16, 256):
        codec = bpe.Codec(bpe.read_spec(path), leaf=leaf)
        for alphabet in ("a", "ab", "the ", "aeiouthng", "é中a", "!?'s re", "İΣ x́\x85\x1c", "\n\t  a", "0123 "):
            for n in (0, 1, 7, 600, 2500):
                text = "".join(rnd.choice(alphabet) for _ in range(n)) + rnd.choice(["", "<|endoftext|>", "<|startoftext|>x"])
                ids = lib.encode(text, add_special_tokens=False).ids
                got = codec.encode(text)
                assert np.frombuffer(got, "<u4").tolist() == ids, (leaf, alphabet, n)
                assert codec.decode(got).decode() == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_known_letter(path):
    """All characters up to U+024F alone, in pairs and in triples with letters, and odd ones among them."""
    lib, codec, rnd = Tokenizer.from_file(path), bpe.Codec(bpe.read_spec(path)), random.Random(6)
    low = [chr(c) for c in range(0x250)]
    odd = [chr(c) for c in (0x250, 0x2BC, 0x301, 0x307, 0x345, 0x3A3, 0x3C2, 0x430, 0x1E9E, 0x200B, 0x2028, 0x2126, 0x212A, 0x212B, 0x3000, 0x4E2D, 0xFB01, 0xFEFF, 0x1F600)]
    texts = ["Əli", "ƏLİYEV", "Ɓoko", "ƐWE", "Ɗan", *low, *odd]
    texts += [a + b for a in low for b in rnd.sample(low, 12)]
    texts += ["".join(rnd.choice(low if rnd.random() < 0.9 else odd) for _ in range(rnd.randint(3, 12))) for _ in range(12_000)]
    texts += [rnd.choice("aZ 9'") + a + rnd.choice("bÉ s\n") for a in low + odd for _ in range(4)]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == e.ids, ascii(text)


def test_other_settings_are_an_error():
    spec = json.loads(bpe.read_spec(WORD))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}, {"model": {**spec["model"], "dropout": 0.1}}):
        with pytest.raises(ValueError, match="supported"):
            bpe.kind_of({**spec, **change})
    stripped = [{**t, "lstrip": True} for t in spec["added_tokens"]]
    with pytest.raises(ValueError, match="supported"):
        bpe.kind_of({**spec, "added_tokens": stripped})


def test_join_agrees_wherever_it_is_cut():
    codec = bpe.Codec(bpe.read_spec(BYTE))
    rnd = random.Random(4)
    for _ in range(150):
        s = "".join(rnd.choice(rnd.choice(["ab", "ing", "aaaaab", "estra"])) for _ in range(rnd.randint(2, 80)))
        k = rnd.randint(1, len(s) - 1)
        assert codec.join(codec.direct(s[:k], False), codec.direct(s[k:], True), True) == codec.direct(s, True)


def test_byte_round_trip():
    codec = bpe.Codec(bpe.read_spec(BYTE))
    for text in ("", "a  b\n", "Straße 中文 \U0001f600", "x" * 5000):
        assert codec.decode(codec.encode(text)).decode() == text


@pytest.mark.parametrize("spread", [1 << 16, 500])
def test_documents(spark, spread, monkeypatch):
    df = awkward(spark)
    lib = Tokenizer.from_file(WORD)
    monkeypatch.setattr(bpe, "SPREAD", spread)  # local workers fork from this process only in part, so the driver's own pass is held against it too
    want = []
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = pairs(bpe.encode_documents(df, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(empty(spark), WORD).count() == 0


def test_long_words_meet_again(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("ab") for _ in range(200_000))
    text = f"start {long} mid {long[::-1]}c end"
    df = spark.createDataFrame([(1, text), (1, text), (2, long)], "doc_id long, text string").repartition(3)
    lib = Tokenizer.from_file(WORD)
    want = sorted((i, hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in ((1, text), (1, text), (2, long)))
    out = bpe.encode_documents(df, WORD, keep_ids=True, keep_text=True)
    assert pairs(out, "doc_id", "ids_sha256") == want
    assert all(len(r.ids) == 4 * r.n_tokens and r.decoded for r in out.collect())

"""BPE encoding and decoding with tree concatenation of long unsplit text.

A text is normalised and split into words as its tokenizer file says. Words up to
``leaf`` symbols go through the merge table at once and are remembered. A longer word is
unsplit text, whose direct encoding is the slow case of BPE: it is halved down to leaves,
the leaves are encoded on their own, and neighbours are joined pairwise up the tree. At a
join the tokens next to it are encoded again in a window that doubles until its first
token is the left side's and its last the right side's. A token sequence is the encoding
of its text exactly if every adjacent pair is, and a window that agrees on both sides
leaves only such pairs, so the joined sequence is the one that direct encoding gives.

In ``encode_documents`` the leaves of very long words become rows of their own, are dealt
over all tasks, and meet again ordered by position in the task of their document.

Only the settings of the two supported files are known here; a file with others is an error.

Defined cases: a null text counts as empty; an empty text has no tokens and the digests of
zero bytes; a very long text is a row like any other, its long words dealt out; repeated rows give
repeated results; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import bounded_batches, columns_of, cut, to_batch

#: Symbols of a word that are encoded at once.
LEAF = 256
#: A word with more symbols is dealt out to other tasks in pieces of this size.
SPREAD = 1 << 16
#: Words that a task remembers before it starts anew.
CACHE_WORDS = 300_000

# Letters and numbers among the characters up to U+024F, where Unicode versions agree.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_KNOWN = frozenset("\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250)])))


def odd_characters(lower: bool) -> re.Pattern:
    """Characters that the split patterns below do not know, and those whose lower case they do not know."""
    known = [c for c in sorted(_KNOWN) if not lower or _KNOWN.issuperset(c.lower())]
    return re.compile("[^" + re.escape("".join(known)) + "]")


#: The settings of the two supported files, and their split patterns on known characters.
_LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPLIT_BYTES = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _RUNS}, "behavior": "Removed", "invert": True}, {**_BYTES, "use_regex": False}],
}
_JOIN_BYTES = {**_BYTES, "add_prefix_space": True}
_SUPPORTED = {
    "words": (_LOWERING, _SPLIT_BYTES, None, rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t\n\r {_L}{_N}]+"),
    "spaced": (
        None, _BYTES, _JOIN_BYTES,
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\t\n\r {_L}{_N}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+",
    ),
}


def kind_of(spec: dict) -> str:
    """Which of the supported settings a tokenizer file has; ValueError if it has others."""
    m = spec["model"]
    plain = m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(t["special"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    for kind, (normalizer, splitter, decoder, _) in _SUPPORTED.items():
        if plain and added and spec.get("post_processor") is None and (spec["normalizer"], spec["pre_tokenizer"], spec["decoder"]) == (normalizer, splitter, decoder):
            return kind
    raise ValueError("the tokenizer file's normalizer, pre-tokenizer, decoder, model options or added tokens are none of the supported ones")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file's text (byte-level BPE)."""

    def __init__(self, spec: str, leaf: int = LEAF):
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        d = json.loads(spec)
        m = d["model"]
        self.leaf = leaf
        self.suffix = m.get("end_of_word_suffix") or ""
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.inner = BPE(vocab=m["vocab"], merges=merges)
        self.final = BPE(vocab=m["vocab"], merges=merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        longest = sorted(self.special, key=lambda t: (-len(t), t))
        self._cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if self.special else None
        kind = kind_of(d)
        self.lower = kind == "words"
        self._odd = odd_characters(self.lower).search
        self._split = re.compile(_SUPPORTED[kind][3]).findall
        self._bytes = byte_symbols()
        self._map = dict(enumerate(self._bytes))
        names = sorted([*m["vocab"].items(), *self.special.items()], key=lambda x: x[1])
        self.names = [""] * (names[-1][1] + 1)
        for s, i in names:
            self.names[i] = s
        if d["decoder"] is None:
            self._glue, self._out = b" ", [s.encode() for s in self.names]
        else:
            back = {c: b for b, c in enumerate(self._bytes)}
            self._glue = b""
            self._out = [s.encode() if s in self.special else bytes(back[c] for c in s) for s in self.names]
        self._seen, self._seen_mapped = _Words(self, False), _Words(self, True)

    # -- encoding ---------------------------------------------------------------------

    def words(self, text: str) -> tuple[list[str], bool]:
        """The words of a text without special tokens; True if they are byte symbols already."""
        if not self._odd(text):
            return self._split(text.lower() if self.lower else text), False
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)], True

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._map)

    def direct(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.final if last else self.inner).tokenize(symbols)]

    def tree(self, symbols: str, last: bool = True) -> list[int]:
        """The ids of one word, by halves."""
        parts = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        return self.join_all([self.direct(p, last and i == len(parts) - 1) for i, p in enumerate(parts)], last)

    def join_all(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Neighbours are joined pairwise until one sequence is left."""
        while len(parts) > 1:
            parts = [
                self.join(parts[i], parts[i + 1], last and i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i]
                for i in range(0, len(parts), 2)
            ]
        return parts[0] if parts else []

    def join(self, a: list[int], b: list[int], last: bool) -> list[int]:
        k = 2
        while True:
            left, right = a[-k:], b[:k]
            ends = last and len(right) == len(b)
            text = "".join([self.names[i] for i in left + right])
            if ends and self.suffix:
                text = text.removesuffix(self.suffix)
            mid = self.direct(text, ends)
            if (len(left) == len(a) or mid[0] == left[0]) and (len(right) == len(b) or mid[-1] == right[-1]):
                return a[: len(a) - len(left)] + mid + b[len(right) :]
            k *= 2

    def parts(self, text: str | None) -> Iterator[bytes | str]:
        """Ids as little-endian bytes, in order; a str is the symbols of a word over SPREAD."""
        for i, seg in enumerate(self._cut.split(text or "") if self._cut else [text or ""]):
            if i % 2:
                yield self.special[seg].to_bytes(4, "little")
                continue
            words, mapped = self.words(seg)
            seen = self._seen_mapped if mapped else self._seen
            if seg and len(seg) > SPREAD and max(map(len, words), default=0) > SPREAD // 4:
                run: list[bytes] = []
                for w in words:
                    s = w if mapped else self.symbols(w)
                    if len(s) > SPREAD:
                        yield b"".join(run)
                        run = []
                        yield s
                    else:
                        run.append(seen.ids([w]))
                yield b"".join(run)
            else:
                yield seen.ids(words)

    def encode(self, text: str | None) -> bytes:
        return b"".join(p if isinstance(p, bytes) else pack(self.tree(p)) for p in self.parts(text))

    # -- decoding ---------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text, special tokens kept."""
        out = self._out
        raw = self._glue.join([out[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw if self._glue else raw.decode("utf-8", "replace").encode()


class _Words:
    """Words to ids as bytes, remembered; the last full cache is kept to draw on."""

    def __init__(self, codec: Codec, mapped: bool):
        self.codec, self.mapped = codec, mapped
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> bytes:
        found = list(map(self.now.get, words))
        if None in found:
            found = [self.one(w) if x is None else x for x, w in zip(found, words, strict=True)]
        return b"".join(found)

    def one(self, word: str) -> bytes:
        ids = self.now.get(word) or self.old.get(word)
        if ids is None:
            c = self.codec
            s = word if self.mapped else c.symbols(word)
            if len(s) > c.leaf:
                return pack(c.tree(s))
            ids = pack(c.direct(s, True))
        if len(self.now) >= CACHE_WORDS:
            self.now, self.old = {}, self.now
        self.now[word] = ids
        return ids


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


_CODECS: dict[int, Codec] = {}


def codec_of(spec) -> Codec:
    """The worker's codec of a broadcast tokenizer file."""
    text = spec.value
    key = hash(text)
    if key not in _CODECS:
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded", pa.string())])
_OUT_DDL = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, decoded string"
_PIECE = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("part", pa.int64()), ("leaf", pa.int32()), ("data", pa.binary())])
_PIECE_DDL = "doc_id long, key binary, part long, leaf int, data binary"
_FIRST = pa.schema([*_OUT, *list(_PIECE)[1:]])
_FIRST_DDL = _OUT_DDL + ", key binary, part long, leaf int, data binary"


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode and decode the texts of (doc_id, text).

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit; null unless ``keep_ids``),
    ids_sha256, decoded_sha256 and decoded (null unless ``keep_text``). The first pass is
    written to the checkpoint folder; documents without a word over SPREAD are finished there and
    meet no shuffle, only the pieces of the others are dealt out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def finish(codec: Codec, ids: bytes) -> tuple:
        text = codec.decode(ids)
        return (
            len(ids) // 4, ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if keep_text else None,
        )

    def first(batches):
        codec = codec_of(spec)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                parts = list(codec.parts(text))
                if all(isinstance(p, bytes) for p in parts):
                    rows.append((doc_id, *finish(codec, b"".join(parts)), None, None, None, None))
                    continue
                key, n = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0
                for p in parts:
                    if isinstance(p, bytes):
                        pieces = [(0, p)]
                    else:  # leaf: 1 within a word, 2 at its end
                        pieces = [(2 if i + SPREAD >= len(p) else 1, p[i : i + SPREAD].encode()) for i in range(0, len(p), SPREAD)]
                    for leaf, data in pieces:
                        rows.append((doc_id, None, None, None, None, None, key, n, leaf, data))
                        n += 1
            yield to_batch(_FIRST, rows)

    def leaves(batches):
        codec = codec_of(spec)
        for batch in batches:
            rows = []
            for doc_id, key, part, leaf, data in zip(*columns_of(batch, *_PIECE.names), strict=True):
                rows.append((doc_id, key, part, leaf, pack(codec.tree(data.decode(), leaf == 2)) if leaf else data))
            yield to_batch(_PIECE, rows)

    def last(batches):
        codec = codec_of(spec)
        own, parts, copies, at = None, [], 0, -1

        def close():
            out, word = [], []
            for leaf, data in parts:
                if not leaf:
                    out.append(data)
                    continue
                word.append(np.frombuffer(data, "<u4").tolist())
                if leaf == 2:
                    out.append(pack(codec.join_all(word)))
                    word = []
            return [(own[0], *finish(codec, b"".join(out)))] * copies

        for batch in batches:
            rows = []
            for doc_id, key, part, leaf, data in zip(*columns_of(batch, *_PIECE.names), strict=True):
                if own != (doc_id, key):
                    if own is not None:
                        rows += close()
                    own, parts, copies, at = (doc_id, key), [], 0, -1
                copies += part == 0  # the same row given again has every part again
                if part > at:
                    parts.append((leaf, data))
                    at = part
            yield to_batch(_OUT, rows)
        if own is not None:
            yield to_batch(_OUT, close())

    made = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, _FIRST_DDL))
    finished = made.where("key is null").select(*_OUT.names)
    pieces = made.where("key is not null").select(*_PIECE.names)
    dealt = pieces.repartition(F.col("doc_id"), F.col("part")).mapInArrow(leaves, _PIECE_DDL)
    joined = dealt.repartition(F.col("doc_id"), F.col("key")).sortWithinPartitions("doc_id", "key", "part").mapInArrow(last, _OUT_DDL)
    return finished.unionByName(joined)

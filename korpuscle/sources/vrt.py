"""Verticalised text: one token a line, tab-separated attributes, structures as tags.

A file is cut at the ends of its documents, so large files go to many tasks and only one document's
text stands in memory. Tokens behind the last end are a document of their own. The decoded form of corpus workbenches, with attribute columns and tags, is the same format.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTR = re.compile(r'([\w:-]+)="([^"]*)"')
_TAG = re.compile(r"^<(/?)([A-Za-z][\w-]*)([^>]*)>$")
COLUMNS = ("word", "lemma", "pos_tag")
DDL = "doc string, doc_no long, tok_idx int, sent_id int, word string, lemma string, pos_tag string, meta string"


def tokens_of(lines: Iterable[str], mode: str = "adopt", doc_tag: str = "text", first: int = 0) -> Iterator[tuple]:
    """(doc, doc_no, tok_idx, sent_id, word, lemma, pos_tag, meta) for each token line; documents are numbered from ``first``.

    ``adopt`` keeps the file's attributes; ``none`` and ``sidecar`` keep words alone, to be annotated anew.
    """
    if mode not in ("adopt", "none", "sidecar"):
        raise ValueError(f"unknown mode {mode!r}")
    doc, meta, number, tok, sent, in_sent = None, "", first - 1, 0, 0, False
    for line in lines:
        line = line.rstrip("\r\n")
        if not line or line.startswith("<!--") or line.startswith("<?"):
            continue
        m = _TAG.match(line)
        if m and m[2] in (doc_tag, "s", "p", "corpus"):
            if m[2] == doc_tag and not m[1]:
                attrs = dict(_ATTR.findall(m[3]))
                number, tok, sent, in_sent = number + 1, 0, 0, False
                doc = attrs.pop("id", None) or f"doc-{number + 1}"
                meta = "\x1f".join(f"{k}={v}" for k, v in sorted(attrs.items()))
            elif m[2] == "s" and m[1] and in_sent:
                sent, in_sent = sent + 1, False
            continue
        if doc is None:
            doc, number = f"doc-{first + 1}", first
        cells = line.split("\t")
        word = cells[0].replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
        lemma = cells[2 - 1] if mode == "adopt" and len(cells) > 1 else word.lower()
        pos = cells[2] if mode == "adopt" and len(cells) > 2 else "X"
        yield doc, number, tok, sent, word, lemma, pos, meta
        tok, in_sent = tok + 1, True


def read_vrt(spark: SparkSession, path: str, mode: str = "adopt", doc_tag: str = "text") -> DataFrame:
    """The tokens of VRT files, with ``DDL`` for columns.

    doc_no counts the documents of a file; in a file that is read in several splits it counts on from the
    place where the split begins, so it stays unique and in order without a pass over the file. Ids of documents that
    have none (doc-1 and on) are made from it.
    """
    parts = spark.read.text(path, lineSep=f"</{doc_tag}>").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches):
        at, number = None, 0
        for df in batches:
            rows = []
            for text, *place in zip(df["value"], df["file"], df["start"], strict=True):
                if place != at:
                    at, number = place, place[1]
                lines, found = text.splitlines(), 0
                for row in tokens_of(lines, mode, doc_tag, number):
                    rows.append(row)
                    found = 1
                    if len(rows) >= 50_000:
                        yield _frame(rows)
                        rows = []
                opened = sum(1 for x in lines if (m := _TAG.match(x)) and m[2] == doc_tag and not m[1])
                number += max(found, opened)
            yield _frame(rows)

    return parts.mapInPandas(run, DDL)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc", "doc_no", "tok_idx", "sent_id", "word", "lemma", "pos_tag", "meta"])


def decoded_to_vrt(lines: Iterable[str], attributes: tuple[str, ...] = ("word", "pos", "lemma")) -> Iterator[str]:
    """Decoded lines, whose token columns stand in any order, as word, lemma, pos lines."""
    order = [attributes.index(a) for a in ("word", "lemma", "pos") if a in attributes]
    for line in lines:
        line = line.rstrip("\r\n")
        cells = line.split("\t")
        yield line if _TAG.match(line) or len(cells) < len(attributes) else "\t".join(cells[i] for i in order)

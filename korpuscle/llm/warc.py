"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record gives two records that refer to it: ``metadata``, JSON with the source's
WARC and HTTP headers (of a header that stands several times, the list of its values in their order), title and links; and ``conversion``, the visible text. Both keep the target URI and
date, name the response in WARC-Refers-To, carry the response's payload digest in the
metadata, and digests of their own blocks. Record ids are UUIDs of the source's id and the kind, so a task that runs again writes
the same records.

Defined cases: null or empty html is a response with an empty body, whose text is empty; a
null url is left out of the headers; chunks, gzip, deflate and zstd are undone before the text is taken, and a body that is not in the encoding its headers
name, as crawlers leave it, is taken as it is; a body in another encoding has metadata that names it, without title and links, and no conversion; records of other types derive nothing; a record that
breaks off is an error that names its place; of a response without an id no record refers to it; a very long body is one record, as in its source; repeated rows give equal records; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of, to_batch
from .htmltext import blocks_of

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:korpuscle:warc")
#: The date of records whose source gives none.
DATE = "2024-01-01T00:00:00Z"
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
_HREF = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> list[tuple[str, str]]:
    """Header lines; a line that starts with a blank continues the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = _headers(data[data.index(b"\r\n", at) + 2 : end])
        size = get(head, "Content-Length")
        if size is None or not size.isdigit() or end + 4 + int(size) > len(data):
            raise ValueError(f"the record at byte {at} breaks off")
        yield head, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def by_name(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """The values of each header: the one, or the list of them."""
    out: dict[str, list[str]] = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def _dechunked(body: bytes) -> bytes:
    """The chunks put together, as far as they go; a body without any as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        at = m.end() + int(m[1], 16)
        out.append(body[m.end() : at])
        if at == m.end():
            break
        at += 2 * (body[at : at + 2] == b"\r\n")
    return b"".join(out) if out else body


def _inflated(body: bytes, kind: str) -> bytes:
    """The data of one or more compressed members, as far as they go; a body that is not compressed as it is."""
    if kind == "deflate":
        bits = 15 if len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0 else -15
    else:
        bits = 31
    out, rest = [], body
    while rest:
        member = zlib.decompressobj(bits)
        try:
            out += [member.decompress(rest[i : i + 65536]) for i in range(0, len(rest), 65536)]
        except zlib.error:
            break
        rest = member.unused_data
    return b"".join(out) or body


def _frames(body: bytes) -> bytes:
    """The data of one or more zstd frames, as far as they go; a body that starts with none as it is."""
    if not body.startswith(zstandard.FRAME_HEADER):
        return body
    out, rest = [], body
    while rest:
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.append(frame.decompress(rest))
        except zstandard.ZstdError:
            break
        rest = frame.unused_data
    return b"".join(out)


def undone(body: bytes, encodings: str) -> bytes | None:
    """body without the encodings, the last of the list first; None if one of them is not known."""
    for kind in reversed([e for x in encodings.lower().split(",") if (e := x.strip()) and e != "identity"]):
        if kind == "chunked":
            body = _dechunked(body)
        elif kind in ("gzip", "x-gzip", "deflate"):
            body = _inflated(body, kind)
        elif kind == "zstd":
            body = _frames(body)
        else:
            return None
    return body


def response(key: str, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A response record of a page."""
    body = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", sha1(body))), ("WARC-Date", date)]
    head += [("WARC-Target-URI", url.replace("\r", "").replace("\n", ""))] if url else []
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http))]
    return write_record(head, http)


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response; of others none. A body that cannot be decoded has no conversion."""
    if get(headers, "WARC-Type") != "response":
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    http = _headers(lines)
    charset = re.search(r"charset=([\w-]+)", get(http, "Content-Type") or "")
    transfer, content = (", ".join(v for k, v in http if k.lower() == name) for name in ("transfer-encoding", "content-encoding"))
    payload = undone(body, transfer)
    data = None if payload is None else undone(payload, content)
    body = body if payload is None else payload
    try:
        html = (data or b"").decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = (data or b"").decode("utf-8", "replace")
    source = get(headers, "WARC-Record-ID") or ""
    # a response without an id is told from others by what it is
    key = source or record_id("source", get(headers, "WARC-Target-URI") or "", get(headers, "WARC-Date") or "", sha1(block))
    title = _TITLE.search(html)
    links = [unescape(next(x for x in m if x is not None)) for m in (g.groups() for g in _HREF.finditer(html)) if any(x is not None for x in m)]
    envelope = {
        "WARC-Header-Metadata": by_name(headers), "HTTP-Response-Metadata": {"Status": status.decode("latin-1"), "Headers": by_name(http)}, "Payload-Digest": get(headers, "WARC-Payload-Digest") or sha1(body),
        "Payload-Length": len(body), "HTML-Metadata": {"Title": " ".join(unescape(title[1]).split()) if title else None, "Links": links},
    }
    if data is None:
        envelope["Not-Decoded"] = ", ".join(x for x in (content, transfer) if x)
    blocks = {"metadata": json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")}
    if data is not None:
        blocks["conversion"] = "".join(b.text + "\n" for b in blocks_of(html)).encode("utf-8", "surrogatepass")
    out = []
    for kind, data in blocks.items():
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, key)), ("WARC-Date", get(headers, "WARC-Date") or DATE)]
        own += [("WARC-Target-URI", u)] if (u := get(headers, "WARC-Target-URI")) else []
        own += [("WARC-Refers-To", source)] if source else []
        own += [("Content-Type", "application/json" if kind == "metadata" else "text/plain"), ("WARC-Block-Digest", sha1(data))]
        out.append((kind, own, data))
    return out


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("block_digest", pa.string()), ("length", pa.int64()), ("record", pa.binary())])


def derivatives(pages: DataFrame, keep_records: bool = True, date: str = DATE) -> DataFrame:
    """Three records of each page: response, metadata and conversion, with their linking headers.

    ``record`` holds the whole record's bytes, null unless kept.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*columns_of(batch, "page_id", "url", "html"), strict=True):
                source = response(str(page_id), url, html, date)
                ((head, block),) = read_records(source)
                for kind, own, data in [("response", head, block), *derive(head, block)]:
                    record = source if kind == "response" else write_record(own, data)
                    rows.append((page_id, url, kind, get(own, "WARC-Record-ID"), get(own, "WARC-Refers-To"), get(own, "WARC-Block-Digest"), len(data), record if keep_records else None))
            yield to_batch(_OUT, rows)

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, kind string, record_id string, refers_to string, block_digest string, length long, record binary")


_DERIVED = pa.schema([("path", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("record", pa.binary())])
_DERIVED_DDL = "path string, kind string, record_id string, refers_to string, record binary"


def _derived(path: str, head: list[tuple[str, str]], block: bytes) -> list[tuple]:
    return [(path, kind, get(own, "WARC-Record-ID"), get(own, "WARC-Refers-To"), write_record(own, data)) for kind, own, data in derive(head, block)]


def derive_files(files: DataFrame) -> DataFrame:
    """(path, kind, record_id, refers_to, record) derived from whole WARC files (path, content), of one or more gzip members or plain.

    A file is a cell here, so at most 2 GB; ``derive_warc`` reads larger ones.
    """
    bounded_batches(files.sparkSession, 1)

    def run(batches):
        for batch in batches:
            for path, content in zip(*columns_of(batch, "path", "content"), strict=True):
                for head, block in read_records(_inflated(content, "gzip") if content[:2] == b"\x1f\x8b" else content):
                    yield to_batch(_DERIVED, _derived(path, head, block))

    return files.select("path", "content").mapInArrow(run, _DERIVED_DDL)


def derive_warc(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """(path, kind, record_id, refers_to, record) derived from WARC files of any size, read record by record.

    Spark's text reader parts the files where a record ends and the next begins, splits plain files over tasks and unpacks
    ``.gz`` ones. A record whose block holds that mark itself, or that breaks off, is an error; ``derive_files`` reads the former.
    """
    start = f"WARC/{version}\r\n"
    lines = spark.read.option("lineSep", "\r\n\r\n" + start).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    bounded_batches(spark, 50)

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(*columns_of(batch, "path", "content"), strict=True):
                content = content.removeprefix(start.encode())
                if content.strip():
                    ((head, block),) = read_records(start.encode() + content)
                    rows += _derived(name, head, block)
            yield to_batch(_DERIVED, rows)

    return rows.mapInArrow(run, _DERIVED_DDL)

"""HTML extraction, WARC derivatives, license scan, search."""

import base64
import gzip
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from korpuscle.llm import bm25, htmltext, licenses, warc

from .helpers import awkward, empty, pairs


def test_field_on_unseen_pages():
    field = htmltext.trained_field()
    right = total = 0
    for html, marks in htmltext.labelled_pages(120, seed=99):
        got = field.decode(htmltext.blocks_of(html))
        assert len(got) == len(marks)
        right += sum(a == b for a, b in zip(got, marks, strict=True))
        total += len(marks)
    assert right / total > 0.97


#: Pages of other hands than the generator's, with their main text.
PAGES = [
    (
        "<html><body><div><a href=/>Home</a> <a href=/a>About us</a> <a href=/c>Contact</a></div><div><h1>A walk in the hills</h1><p>We set out early, before the sun had risen over the valley.</p>"
        "<p>By noon the path was steep and the wind was cold, but nobody turned back.</p><p>In the evening we reached the hut and slept.</p></div>"
        "<div><div><a href=/1>Older post</a></div><div><a href=/2>Newer post</a></div></div><div>&copy; 2020 Someone</div></body></html>",
        "A walk in the hills We set out early, before the sun had risen over the valley. By noon the path was steep and the wind was cold, but nobody turned back. In the evening we reached the hut and slept.",
    ),
    (
        "<body><header><a href=/>Site</a></header><main><h1>Making bread at home</h1><p>Flour, water and salt are all that you need for a simple loaf.</p><div class='promo-box'>Buy our stuff today.</div>"
        "<p>Let the dough rest overnight, then bake it in a hot oven for forty minutes.</p></main><footer>Imprint and contact</footer></body>",
        "Making bread at home Flour, water and salt are all that you need for a simple loaf. Let the dough rest overnight, then bake it in a hot oven for forty minutes.",
    ),
    (
        "<body><table><tr><td><a href=a>News</a></td><td><a href=b>Sports</a></td><td><a href=c>Weather</a></td></tr></table><table><tr><td><h2>River rises after a week of rain</h2>"
        "<p>The river rose by two metres on Sunday, and the lower town was cut off for hours.</p><p>Firemen helped people out of their houses; nobody was hurt.</p></td></tr></table><p>&copy; 1999 The Paper</p></body>",
        "River rises after a week of rain The river rose by two metres on Sunday, and the lower town was cut off for hours. Firemen helped people out of their houses; nobody was hurt.",
    ),
    (
        "<div id=wrap><div class=menu><ul><li><a href=/>Start</a></li><li><a href=/b>Blog</a></li></ul></div><div class=post><h1>On learning to swim</h1><p>I was thirty when I learned to swim, and I was afraid of the water.</p>"
        "<blockquote>Nobody sinks who breathes out slowly.</blockquote><ul><li>Start where you can stand.</li><li>Go with a friend.</li></ul></div>"
        "<div id=comments><div class=comment><b>Ann</b> Great text, thank you!</div><div class=comment><b>Bob</b> I still sink.</div></div></div>",
        "On learning to swim I was thirty when I learned to swim, and I was afraid of the water. Nobody sinks who breathes out slowly. Start where you can stand. Go with a friend.",
    ),
    (
        "<body><div class='cookie-banner'>We use cookies to improve your visit. <button>Accept</button></div><section><h1>Opening hours</h1><p>The library is open from nine to five on weekdays.</p></section>"
        "<aside><h3>Most read</h3><p>Ten books for the summer</p></aside></body>",
        "Opening hours The library is open from nine to five on weekdays.",
    ),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_field_on_other_pages(page, want):
    assert htmltext.main_text(htmltext.trained_field(), page) == want


@pytest.mark.parametrize(
    "part", ["<a b", "<div>x", '<a "', "<a \"<b '", "<svg>x", "<!--", "</x>y", "<x-a><p>z", "<li></li><ul>", "<textarea>", "<td><table>", "</p", "<div class='"]
)
def test_broken_pages_take_time_in_proportion(part):
    """Twice the page takes about twice the time, a hundred thousand open tags included."""
    took = []
    for n in (50_000, 100_000):
        began = time.process_time()
        htmltext.blocks_of("<div>" * 20_000 + part * n)
        took.append(time.process_time() - began)
    assert took[1] < 3.2 * took[0] + 0.5


def test_viterbi_is_the_best_path():
    field, rnd = htmltext.trained_field(), random.Random(1)
    for html, _ in htmltext.labelled_pages(30, seed=5000):
        blocks = htmltext.blocks_of(html)[:9]
        s = field.scores(blocks)

        def worth(path, s=s):
            return sum(v for v, y in zip(s, path, strict=True) if y) + sum(field.move[int(a), int(b)] for a, b in zip(path, path[1:], strict=False))

        best = max(worth([bool(k >> i & 1) for i in range(len(blocks))]) for k in range(1 << len(blocks)))
        assert worth(field.decode(blocks)) == pytest.approx(best)
    assert rnd and field.decode([]) == []


def test_blocks():
    html = '<html><head><title>t</title></head><body><p>a<b>b</b> &amp;&#233;\n c<br>d<p>e<script>if (a<b) {}</script>f</p><div>x<ul><li>1<li>2</ul>y</div><!-- <p>no</p> --><p>cut &am'
    assert [b.text for b in htmltext.blocks_of(html)] == ["ab &é c d", "ef", "x", "1", "2", "y", "cut &am"]
    assert htmltext.blocks_of(None) == [] and htmltext.blocks_of("") == [] and [b.text for b in htmltext.blocks_of("a < b > c")] == ["a < b > c"]
    assert [b.text for b in htmltext.blocks_of("</p></div>x<p")] == ["x<p"]


def test_pages(spark):
    page = '<html><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title</h1><p>First text here, quite long enough to read.</p><p>Second&nbsp;text.</p><div class="comments"><div class="comment">Nice one!</div></div></article><form><p>Send us mail.</p></form><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page, 9), (1, "u", page, 9), (2, None, None, 9), (3, "v", "", 9), (None, "w", "<p>", 9)]
    out = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    want = "Title First text here, quite long enough to read. Second text."
    assert pairs(out, "page_id", "text", "n_chars") == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (None, "", 0)], key=repr)
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_records():
    source = warc.response("7", "http://a.example/x", '<title>A &amp; b</title><p>Hi <a href="/l?a=1&amp;b=2">link</a></p>')
    ((head, block),) = warc.read_records(source)
    kinds = {k: (h, b) for k, h, b in warc.derive(head, block)}
    meta, text = kinds["metadata"], kinds["conversion"]
    assert text[1] == b"Hi link\n"
    j = json.loads(meta[1])["Envelope"]
    assert j["HTML-Metadata"] == {"Title": "A & b", "Links": ["/l?a=1&b=2"]} and j["HTTP-Response-Metadata"]["Status"] == "HTTP/1.1 200 OK"
    assert j["WARC-Header-Metadata"]["WARC-Record-ID"] == warc.get(head, "WARC-Record-ID") and j["Payload-Digest"] == warc.get(head, "WARC-Payload-Digest")
    for h, b in kinds.values():
        assert warc.get(h, "WARC-Refers-To") == warc.get(head, "WARC-Record-ID") and warc.get(h, "WARC-Target-URI") == "http://a.example/x" and warc.get(h, "WARC-Date") == warc.get(head, "WARC-Date")
        assert warc.get(h, "WARC-Block-Digest") == warc.sha1(b)
        ((again, data),) = warc.read_records(warc.write_record(h, b))
        assert data == b and again[:-1] == h
    assert warc.derive([("WARC-Type", "request")], b"") == []
    for broken in (b"nonsense", source[:-40]):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))


def derived(http, body, **more):
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), *more.get("warc", [])]
    block = "\r\n".join(["HTTP/1.1 200 OK", *http]).encode() + b"\r\n\r\n" + body
    kinds = {k: b for k, _, b in warc.derive(head, block)}
    return json.loads(kinds["metadata"])["Envelope"], kinds.get("conversion")


def test_warc_keeps_repeated_headers():
    j, _ = derived(["Set-Cookie: a=1", "Via: x", "Set-Cookie: b=2"], b"<p>a", warc=[("WARC-Concurrent-To", "<1>"), ("WARC-Concurrent-To", "<2>")])
    assert j["HTTP-Response-Metadata"]["Headers"] == {"Set-Cookie": ["a=1", "b=2"], "Via": "x"}
    assert j["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<1>", "<2>"]


def test_warc_undoes_encodings():
    page = "<title>T</title><p>Grüße an alle".encode()
    raw = zlib.compressobj(wbits=-15)
    packed = {"gzip": gzip.compress(page[:9]) + gzip.compress(page[9:]), "x-gzip": gzip.compress(page), "deflate": zlib.compress(page), "Deflate": raw.compress(page) + raw.flush(), "identity": page}
    z = zstandard.ZstdCompressor()
    packed["zstd"] = z.compress(page[:9]) + z.compress(page[9:])
    chunked = lambda b: b"".join(b"%x;e=1\r\n%s\r\n" % (len(c), c) for c in (b[i : i + 7] for i in range(0, len(b), 7))) + b"0\r\nTrailer: x\r\n\r\n"
    want = "Grüße an alle\n".encode()
    for kind, body in packed.items():
        j, text = derived([f"Content-Encoding: {kind}"], body)
        assert (text, j["HTML-Metadata"]["Title"], j["Payload-Length"]) == (want, "T", len(body))
        j, text = derived([f"Content-Encoding: {kind}", "Transfer-Encoding: chunked"], chunked(body))
        assert text == want and j["Payload-Length"] == len(body)
    assert derived(["Transfer-Encoding: gzip, chunked"], chunked(gzip.compress(page)))[1] == want
    for kind in ("gzip", "zstd"):
        assert derived(["Transfer-Encoding: chunked", f"Content-Encoding: {kind}"], page)[1] == want
    assert derived(["Content-Encoding: zstd"], z.compress(page[:9]) + z.compress(page[9:])[:-1])[1] == want.replace(b"e\n", b"\n")
    assert derived(["Content-Encoding: zstd"], z.compress(page * 50)[:-1])[1] == derived([], b"")[1]  # its one block is not whole
    assert derived(["Transfer-Encoding: chunked"], chunked(page)[:-30])[1].startswith("Gr".encode())
    j, text = derived(["Content-Encoding: br"], b"\x8b\x00")
    assert text is None and j["Not-Decoded"] == "br" and j["HTML-Metadata"] == {"Title": None, "Links": []}


def test_warc_files(spark, tmp_path):
    """Files read whole and by record, plain and packed, against what was put in."""
    pages = [(f"http://a.example/{k}", f"T{k} <b>", f"word{k} é 中文 " * (k + 1)) for k in range(30)]
    sources = [warc.response(str(k), u, f"<title>{t}</title><p>{x}</p>\r\n<a href='/l{k}'>go</a>") for k, (u, t, x) in enumerate(pages)]
    info = warc.write_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n")
    (tmp_path / "plain").mkdir(), (tmp_path / "packed").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(info + b"".join(sources))
    (tmp_path / "packed/a.warc.gz").write_bytes(b"".join(map(gzip.compress, [info, *sources])))
    whole = [warc.derive_files(spark.read.format("binaryFile").load(str(tmp_path / d))) for d in ("plain", "packed")]
    for out in [*whole, *(warc.derive_warc(spark, str(tmp_path / d)) for d in ("plain", "packed"))]:
        rows = out.collect()
        assert Counter(r.kind for r in rows) == {"metadata": 30, "conversion": 30}
        by_url = {}
        for r in rows:
            head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
            own = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(own["Content-Length"])]
            assert rest[len(block) :] == b"\r\n\r\n" and own["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            by_url.setdefault(own["WARC-Target-URI"], {})[r.kind] = (own["WARC-Refers-To"], block)
        for k, (u, t, x) in enumerate(pages):
            assert by_url[u]["conversion"][1].decode() == " ".join(x.split()) + "\ngo\n"
            j = json.loads(by_url[u]["metadata"][1])["Envelope"]
            assert j["HTML-Metadata"] == {"Title": t, "Links": [f"/l{k}"]} and by_url[u]["metadata"][0] == by_url[u]["conversion"][0] == j["WARC-Header-Metadata"]["WARC-Record-ID"]
            assert f"WARC-Record-ID: {by_url[u]['metadata'][0]}".encode() in sources[k]
    (tmp_path / "plain/a.warc").write_bytes(sources[0][:-30])
    with pytest.raises(Exception, match="breaks off"):
        warc.derive_warc(spark, str(tmp_path / "plain")).collect()


def test_warc_without_ids():
    made = [warc.derive([("WARC-Type", "response"), ("WARC-Target-URI", u)], b"HTTP/1.1 200 OK\r\n\r\n<p>a") for u in "ab"]
    assert len({warc.get(h, "WARC-Record-ID") for m in made for _, h, _ in m}) == 4
    assert all(warc.get(h, "WARC-Refers-To") is None for m in made for _, h, _ in m)


def test_warc_tables(spark):
    rows = [(1, "u", "<p>a", 0), (1, "u", "<p>a", 0), (2, None, None, 0), (None, "w", "", 0)]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string, kind long")).collect()
    assert Counter(r.kind for r in out) == {"response": 4, "metadata": 4, "conversion": 4}
    assert len({r.record_id for r in out}) == 9
    ids = {r.record_id for r in out if r.kind == "response"}
    assert all(r.refers_to in ids for r in out if r.kind != "response")
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    file = b"".join(bytes(r.record) for r in out if r.kind == "response")
    made = warc.derive_files(spark.createDataFrame([("f", bytearray(file))], "path string, content binary")).collect()
    assert {r.record_id for r in made} == {r.record_id for r in out if r.kind != "response"}


def slow_scan(text, templates=licenses.TEMPLATES, theta=licenses.THETA, short=licenses.SHORT):
    """Every block of every template, one by one."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, best = {x for _, x in places}, 0.0
    every = [(label, re.findall("[a-z0-9]+", t)) for label, texts in templates.items() for t in texts]
    for label, t in every:
        own = set(t)
        need = len(own) if len(own) <= short else int(np.ceil(theta * len(own) - 1e-9))
        width = len(t) if len(own) <= short else int(np.ceil(len(t) / theta - 1e-9))
        rivals = [set(o) - own for other, o in every if other != label and own < set(o)]
        for i, w in enumerate(words):
            held = set(words[i : i + width])
            if w in own and len(held & own) >= need and held >= own & licenses.TELLING and not any(held >= r for r in rivals):
                labels.add(label)
                best = max(best, len(held & own) / len(own))
    base = {x for _, x in places}
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else round(best, 9))


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scanned(df, **options):
    return pairs(licenses.license_scan(df, **options).withColumn("score", F.round("score", 9)), *COLUMNS)


def test_licenses(spark):
    rnd = random.Random(2)
    texts = ["MIT License mit license\nMIT LICENSE", "x\nLicensed under the Apache License, Version 2.0.\ny", "the mit", "license", "general public license mit license", "ß mit license é", "mit liKense K mİt license"]
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    bits = [w for t in every for w in t.split()] + ["\n", "zz", ", "]
    texts += [" ".join(rnd.choices(bits, k=rnd.randint(1, 60))) for _ in range(60)]
    for t in every:
        w = t.split()
        lost = [x for x in w if rnd.random() > 0.12]
        more = [y for x in w for y in ([x, "zz"] if rnd.random() < 0.1 else [x])]
        pad = " ".join(rnd.choices(bits, k=rnd.choice([0, 3, 700])))
        texts += [" ".join(lost), " ".join(more), "\n * ".join(w), " ".join(w[: len(w) // 2]), f"{pad} {t} {pad}", rnd.choice(every) + " " + t]
        rnd.shuffle(w)
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, score double, labels long, row long").unionByName(
        awkward(spark).selectExpr("doc_id", "text", "score", "length as labels", "row")
    )
    got = scanned(df)
    assert got == sorted(((r.doc_id, *slow_scan(r.text)) for r in df.collect()), key=repr)
    assert len({x for g in got for x in g[6].split(",")}) > len(licenses.TEMPLATES) - 1
    assert licenses.license_scan(empty(spark)).count() == 0
    assert licenses.license_scan(df, templates={}).where("labels <> base_labels").count() == 0


def test_license_labels(spark):
    """Licenses that differ in a word, words that only lie about, and notices over several lines."""
    want = {
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "licensed under cc by-sa 4.0 and": "cc-by-sa", "CC BY-NC-SA 4.0": "cc-by-nc-sa",
        "This work is under a Creative Commons Attribution-ShareAlike\n4.0 International License.": "cc-by-sa",
        "Creative Commons Attribution 4.0 International License": "cc-by",
        "All the people who live here have rights and the town kept a reserved seat": "", "all rights\nreserved": "rights-reserved", "All rights reserved. 2020": "rights-reserved",
        "Licensed under the MIT License version 2.0": "mit", "under the terms of the apache public license this source code form is subject to": "",
        "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software": "mit",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that": "bsd",
        "# This program is free software: you can redistribute it and/or modify it\n# under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n"
        "# (at your option) any later version.": "gpl,lgpl",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert pairs(licenses.license_scan(df), "doc_id", "labels") == sorted(((i, x) for i, x in enumerate(want.values())), key=repr)


def test_license_of_the_greater_template(spark):
    templates = {"one": ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"], "two": ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny"]}
    texts = [templates["one"][0], templates["two"][0], templates["two"][0].replace("alpha", "x"), templates["one"][0] + " x" * 30 + " ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scanned(df, templates=templates)
    assert got == sorted(((i, *slow_scan(t, templates)) for i, t in enumerate(texts)), key=repr)
    assert [g[6] for g in got] == ["one,two", "two", "two", "one,two"] and [g[7] for g in got][1] == 1.0


def test_license_scan_is_native(spark, monkeypatch):
    monkeypatch.setattr(licenses, "cut", lambda df: df)
    plan = licenses.license_scan(awkward(spark))._jdf.queryExecution().toString()
    assert "array_intersect" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_license_filter_by_place(spark):
    rows = [(13, 0, 13, 0, 12), (13, 2, 13, 1, 12), (13, 1, 13, 2, 12), (12, 1, 13, 0, 12), (5, 0, 13, 0, 12)]
    df = spark.createDataFrame(rows, "words int, at int, size int, place int, need int")
    got = df.select(licenses.positional(*[F.col(c) for c in df.columns]).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]


def slow_search(texts, k):
    vec = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t in texts]
    n, mean = len(vec), sum(sum(v.values()) for v in vec) / max(1, len(vec))
    df = Counter(t for v in vec for t in v)
    out = []
    for (q, _), v in zip(texts, vec, strict=True):
        if q is None or q % 5:
            continue
        scores = []
        for (d, _), w in zip(texts, vec, strict=True):
            s = sum(np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w[t] * (bm25.K1 + 1) / (w[t] + bm25.K1 * (1 - bm25.B + bm25.B * sum(w.values()) / mean)) for t in v if t in w)
            if s > 0:
                scores.append((-round(s, 6), -1 if d is None else d))
        out += [(q, r + 1, None if d == -1 else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "frequent", "block", "queries", "dense"), [(1000, 8, 64, 99, 256), (9, 2, 4, 2, 3), (15, 100, 2, 5, 7)])
def test_search(spark, shard, frequent, block, queries, dense, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES", queries)
    monkeypatch.setattr(bm25, "DENSE", dense)
    monkeypatch.setattr(bm25, "FREQUENT", frequent)
    monkeypatch.setattr(bm25, "BLOCK", block)
    df = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = bm25.search(df, F.col("doc_id") % 5 == 0, k=4, shard=shard).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
    assert pairs(got, "query_id", "rank", "doc_id", "score") == slow_search([(r.doc_id, r.text) for r in df.collect()], 4)


def test_rows_and_blocks_are_dealt_evenly(spark):
    """A third of the rows are one row; every block of queries and shard has its own partition."""
    rows = [(1, "same words here")] * 300 + [(i, f"w{i} words") for i in range(2, 602)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    deal = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(6))
    assert max(r["count"] for r in bm25.vectors(df).groupBy(deal).count().collect()) < 220
    for n in (1, 7, 40):
        keys = spark.createDataFrame([(k,) for k in bm25.own_partitions(spark, n)], "key int").repartition(n, "key")
        assert [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()] == [1] * n


def test_counts_beyond_a_byte():
    n, terms, counts = bm25.vector("a " * 300 + "b " * 255 + "c")
    assert n == 556 and sorted(bm25.unpacked([counts, counts], [3, 3]).tolist()) == [1, 1, 255, 255, 300, 300] and len(terms) == 24


def test_search_awkward(spark):
    df = awkward(spark)
    out = bm25.search(df, F.col("doc_id") % 5 == 0, k=3).collect()
    assert Counter(r.query_id for r in out)[0] == 3 and all(r.score > 0 for r in out)
    assert bm25.search(empty(spark), F.col("doc_id") % 5 == 0).count() == 0


def test_shard_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    terms = [rng.choice(60, rng.integers(3, 30), replace=False, p=np.arange(60, 0, -1) / 1830) for _ in range(700)]
    rows = [(np.sort(t).astype("<u8").tobytes(), rng.integers(1, 5, len(t)).astype("u1").tobytes()) for t in terms]
    s = bm25.Shard(list(range(700)), [int(np.frombuffer(c, "u1").sum()) for _, c in rows], [h for h, _ in rows], [c for _, c in rows], 30.0)
    assert len(s.dense) and (s.dense_of < 0).any()
    for t in terms[:40]:
        h, idf = np.sort(t).astype("<u8"), rng.random(len(t)) + 0.1
        total = np.zeros(700)
        for x, w in zip(h, idf, strict=True):
            k = int(np.searchsorted(s.terms, x))
            at = slice(s.starts[k], s.starts[k] + s.df[k])
            total[s.doc[at]] += w * s.impact[at]
        order = np.lexsort((np.arange(700), -np.round(total, 9)))[:5]
        assert s.search(h, idf, 5) == [(int(i), pytest.approx(total[i], abs=1e-8)) for i in order]


def test_shards_of_parts_answer_many_queries_exactly():
    """Parts joined, queries in one product of single precision, copies by id, and only rows that reach the least score."""
    rng = np.random.default_rng(5)
    rows = [bm25.vector(" ".join(f"w{t}" for t in rng.zipf(1.3, rng.integers(1, 400)) if t < 500)) for _ in range(150)]
    rows += [rows[3]] * 40 + [bm25.vector("w1 " * 300 + "w2"), bm25.vector(None)]
    ids = [int(i) for i in rng.permutation(len(rows))]
    cuts = [slice(0, 70), slice(70, 71), slice(71, None)]
    parts = [bm25.inverted(ids[c], *[list(x) for x in zip(*rows[c], strict=True)]) for c in cuts]
    parts = [bm25.unpack(bm25.pack(p, bm25.KEPT), bm25.KEPT) for p in parts]
    s = bm25.Shard.of(parts, 150.0)
    assert len(s.dense) and (s.dense_of < 0).any() and s.dense.dtype == np.float32
    queries = [(np.frombuffer(h, "<u8"), rng.random(len(h) // 8) + 0.1) for _, h, _ in rows[:190]]
    found = list(s.search_all(((s.places_of(h), w) for h, w in queries), 5, [0.0] * len(queries)))
    for (h, idf), (got, scores) in zip(queries, found, strict=True):
        weight, total = dict(zip(h.tolist(), idf, strict=True)), np.zeros(len(rows))
        for i, (n, terms, counts) in enumerate(rows):
            terms = np.frombuffer(terms, "<u8").tolist()
            for t, tf in zip(terms, bm25.unpacked([counts], [len(terms)]), strict=True):
                total[i] += weight.get(t, 0) * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * n / 150))
        order = [i for i in np.lexsort((ids, -np.round(total, 9)))[:5] if total[i] > 0]
        assert [ids[i] for i in order] == got.tolist() and scores == pytest.approx(total[order], abs=1e-8)
    h, idf = queries[0]
    assert [x.tolist() for x in next(s.search_all([(s.places_of(h), idf)], 5, [float(found[0][1][1])]))] == [x[:2].tolist() for x in found[0]]


def test_search_writes_the_index_once(spark, monkeypatch):
    """Ten blocks of queries write about as many bytes as one."""

    def written(queries):
        monkeypatch.setattr(bm25, "QUERIES", queries)
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = lambda: {(f := all_.apply(i)).getPath(): f.length() for all_ in [manager.getAllFiles()] for i in range(all_.size())}
        before = files()
        got = bm25.search(df, F.col("doc_id") % 5 == 0, k=4, shard=50).collect()
        return sum(v for p, v in files().items() if p not in before), sorted(map(tuple, got))

    rows = [(i, " ".join(f"w{(i * j * 7919) % 4001}" for j in range(1, 400))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    (one, same), (ten, got) = written(1000), written(3)
    assert got == same and one > 100_000 and ten < 2 * one
    df.unpersist()

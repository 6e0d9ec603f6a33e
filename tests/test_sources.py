"""Readers, rejects, cleaning, sinks and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from korpuscle.operators import kwic
from korpuscle.plans import plain
from korpuscle.sources import clean, readers, sinks, vrt
from korpuscle.streaming import ingest


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id;text;genre\n1;"one; two";x\n;three;y\n3;;z\n', encoding="utf-8")
    r = readers.read_csv(spark, str(p))
    got = {x.text: (x.id, x.genre) for x in r.rows.collect()}
    assert got["one; two"] == ("1", "x") and got["three"][0].startswith("doc-")
    assert [(x.reason, x.n) for x in r.report().collect()] == [("empty_text_column", 1)]
    with pytest.raises(readers.ImportFailed):
        r.checked("fail_fast")
    assert readers.sniff_delimiter('a\tb\t"c,d,e,f"') == "\t"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(['{"id": "a", "body": {"text": "hi"}, "y": 3}', "{broken", "[1, 2]", '{"id": "b", "body": {"text": " "}}', "", '{"body": {"text": "' + "x" * 200 + '"}}']), encoding="utf-8")
    r = readers.read_jsonl(spark, str(p), text="body.text", meta=["y"], max_line=100)
    assert [(x.id, x.text, x.y) for x in r.rows.collect()] == [("a", "hi", "3")]
    assert {x.reason: x.n for x in r.report().collect()} == {"malformed_json": 1, "non_object_line": 1, "empty_text_column": 1, "line_too_large": 1}


def test_text_and_parquet(spark, tmp_path):
    d = tmp_path / "t" / "news"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("one\n\ntwo")
    assert [(x.id, x.register) for x in readers.read_text(spark, str(tmp_path / "t")).rows.collect()] == [("a", "news")]
    assert sorted(x.id for x in readers.read_text(spark, str(tmp_path / "t"), paragraphs=True).rows.collect()) == ["a#0", "a#1"]
    spark.createDataFrame([("1", "x")], "id string, text string").write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p")).rows.count() == 1


def test_prealigned(spark):
    rows = [("1", "a", "source"), ("2", "a", "v"), ("3", "b", "v"), ("4", "c", "v"), ("5", "c", "v"), ("6", None, "v"), ("7", "a", None)]
    r = readers.prealigned(spark.createDataFrame(rows, "id string, pair_id string, pair_role string"))
    assert sorted(x.id for x in r.rows.collect()) == ["1", "2"]
    assert {x.reason: x.n for x in r.report().collect()} == {"singleton_pair_group": 1, "invalid_anchor_count": 2, "missing_pair_key": 1, "missing_pair_role": 1}


def test_vrt(spark, tmp_path):
    text = '<text id="t1" genre="x">\n<s>\nGo\tgo\tV\n&amp;\t&\tC\n</s>\n<s>\n.\t.\tP\n</s>\n</text>\n<text>\nHi\thi\tI\n</text>\n'
    (tmp_path / "a.vrt").write_text(text)
    got = [(r.doc, r.tok_idx, r.sent_id, r.word, r.pos_tag, r.meta) for r in vrt.read_vrt(spark, str(tmp_path / "a.vrt")).collect()]
    assert got == [("t1", 0, 0, "Go", "V", "genre=x"), ("t1", 1, 0, "&", "C", "genre=x"), ("t1", 2, 1, ".", "P", "genre=x"), ("doc-2", 0, 0, "Hi", "I", "")]
    assert [t[6] for t in vrt.tokens_of(text.splitlines(), "none")] == ["X"] * 4
    assert list(vrt.decoded_to_vrt(["<s>", "Go\tV\tgo"])) == ["<s>", "Go\tgo\tV"]


def test_clean(spark):
    df = spark.createDataFrame([(1, " ﬁne\r\n\r\n\r\nx​\t y ")], "id long, text string")
    assert df.select(clean.normalized(F.col("text")).alias("t")).first().t == "fine\n\nx y"
    long = spark.createDataFrame([("d", "aaa bbb\n\nccc ddd eee"), ("e", "x"), ("f", None)], "id string, text string")
    assert [(r.id, r.text) for r in clean.split_long(long, 9).collect()] == [("d#0", "aaa bbb"), ("d#1", "ccc ddd"), ("d#2", "eee"), ("e", "x"), ("f", None)]
    assert clean.split_points("abcdefgh", 3) == ["abc", "def", "gh"]


def test_sinks(spark, tea, tmp_path):
    sinks.write_corpus(tea, str(tmp_path / "c"))
    reg = sinks.Registry(spark)
    reg.register("tea", str(tmp_path / "c"))
    again = reg.activate("tea")
    assert plain.search(again, "tea").count() == 17
    k = kwic.lines(again, plain.search(again, "tea"), 2).select("doc_id", "left", "node", "right")
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        sinks.write_concordance(k, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 17
    e = sinks.evidence(k, {"q": "tea"})
    assert e["rows"] == 17 and e["digest"] == sinks.evidence(k.orderBy("left"), {})["digest"]
    json.dumps(sinks.method_card("search", tea, query="tea"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "A cup of tea.")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.token_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("toks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(*) n, count_if(is_word) w from toks").first().asDict() == {"n": 5, "w": 4}
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 02:00:00", "y")], "ts string, e string").withColumn("ts", F.to_timestamp("ts"))
    assert ingest.term_counts(ev, "e").count() == 2 and ingest.sessions(ev, "e").count() == 2


def test_vrt_files_are_split_at_documents(spark, tmp_path):
    (tmp_path / "v").mkdir()
    doc = lambda i: (f'<text id="d{i}" lang="en">' if i % 3 else "<text>") + f"\n<s>\nword{i}\tword\tNN\n.\t.\t$.\n</s>\n</text>\n"
    whole = "<corpus>\n" + "".join(map(doc, range(300))) + "</corpus>\n"
    (tmp_path / "v/a.vrt").write_text(whole)
    (tmp_path / "v/b.vrt").write_text("free\tfree\tJJ\n")
    want = sorted([*vrt.tokens_of(whole.splitlines()), ("doc-1", 0, 0, 0, "free", "free", "JJ", "")])
    got = vrt.read_vrt(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, got.collect())) == want
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = vrt.read_vrt(spark, str(tmp_path / "v/a.vrt"))
        assert split.rdd.getNumPartitions() > 5
        rows = split.orderBy("doc_no", "tok_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.word, r.tok_idx) for r in rows] == [(f"word{i}" if k == 0 else ".", k) for i in range(300) for k in (0, 1)]
    assert len({r.doc_no for r in rows}) == 300 == len({r.doc for r in rows})

"""The user object, jobs, spacing, parallel lines and the workbook sink."""

import zipfile

import pytest
from pyspark.sql import functions as F

from korpuscle.api import Analysis
from korpuscle.jobs import Jobs
from korpuscle.operators import kwic, pairs
from korpuscle.operators.corpus import Corpus
from korpuscle.plans import plain
from korpuscle.sources import sinks


@pytest.fixture(scope="module")
def a(tea):
    return Analysis(tea)


def test_every_analysis(a):
    blog, news = F.col("register") == "blog", F.col("register") == "news"
    assert a.count("tea") == 17 and a.count("tea", {"register": "blog"}) == 13
    assert a.kwic("tea", sort=["meta:register", "1R"], sample=(5, 3)).count() == 5
    assert a.diagnose("[")["ok"] is False
    assert a.frequency(scope={"register": "blog"}).where("key = 'tea'").first().freq == 13
    assert a.frequency_contrast(blog, news, 1).where("word_lc = 'tea'").first().f_r == 4
    assert a.ngrams(2, {"register": "blog"}).count() > 0 and a.ngram_contrast(blog, news, 2, 1).count() > 0
    assert a.collocates("tea", 3).first().collocate == "green"
    assert a.collocates('[word="green"%c] [word="tea"]', 3, min_freq=2).count() > 0
    assert a.co_kwic("tea", ["green"], 2).count() == 7 and a.network("tea", 1, 8).count() > 0
    assert a.collocation_contrast("tea", blog, news).count() > 0 and a.keyness(blog).count() == 7 and a.context_keyness("tea").count() > 0
    assert a.trend("tea", "date").count() == 4 and a.dispersion("tea").first().hits == 17
    d = a.lexical_diversity(sttr_window=20, mattr_window=20).first()
    assert d.types == 75 and d.mattr == pytest.approx(0.891026, abs=1e-6)
    assert a.search_docs(["tea"], "tf", 1).first().score == 4.0


def test_jobs(spark, a):
    jobs = Jobs(spark)
    ok = jobs.create("frequency", lambda: a.frequency())
    assert jobs.wait(ok, 60) == "done" and len(jobs.page(ok, 10, 5)) == 5 and jobs.status(ok)["rows"] == 66
    assert jobs.status(ok)["truncated"] is False
    bad = jobs.create("bad", lambda: a.hits("the people"))
    assert jobs.wait(bad, 60) == "error" and jobs.status(bad)["error"]
    slow = jobs.create("slow", lambda: spark.range(10**13).agg(F.sum(F.rand())))
    assert jobs.cancel(slow) and jobs.wait(slow, 60) == "cancelled" and not jobs.cancel(slow)


def test_source_spacing(spark):
    c = Corpus.from_documents(spark.createDataFrame([(1, "One, (two)  three.\nFour")], "doc_id long, text string"), spacing=True)
    r = kwic.source_lines(c, plain.search(c, "two"), 3).first()
    assert (r.left, r.node, r.right) == ("One, (", "two", ") three.")
    assert kwic.snippet(c, plain.search(c, "three"), 1).first().snippet == ") three ."
    assert kwic.document_list(c).count() == 1


def test_parallel_lines(spark):
    rows = [(1, "The cat sat down. It rained.", "p"), (2, "A dog ran. The cat sat up.", "p"), (3, "Other.", "q")]
    c = Corpus.from_documents(spark.createDataFrame(rows, "doc_id long, text string, pair string"))
    r = pairs.parallel_lines(c, plain.search(c, "rained OR cat").where("doc_id = 1"), "pair").orderBy("sent_id").collect()
    assert [(x.sent_id, x.other_id, x.other_sent) for x in r][0] == (0, 2, 1) and len(r) == 2


def test_workbook(spark, a, tmp_path):
    p = tmp_path / "a.xlsx"
    assert sinks.write_xlsx(a.kwic("tea").select("doc_id", "left", "node"), str(p)) == 17
    with zipfile.ZipFile(p) as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 18

"""Query languages: reading, rejecting, and agreement with brute force."""

import random

import pytest

from korpuscle.operators.corpus import Corpus
from korpuscle.plans import cql, matching, plain
from korpuscle.plans.nfa import Automaton

GERMAN = [
    "ich/PPER/ich gehe/VVFIN/gehen nach/APPR/nach hause/NN/haus ./$./.", "du/PPER/du gehst/VVFIN/gehen nach/APPR/nach berlin/NE/berlin ./$./.",
    "wir/PPER/wir gehen/VVFIN/gehen heute/ADV/heute nicht/PTKNEG/nicht ./$./.", "gehen/VVINF/gehen wir/PPER/wir jetzt/ADV/jetzt ?/$?/?",
]


@pytest.fixture(scope="module")
def german(spark):
    rows, i = [], 0
    for s in GERMAN:
        for t in s.split():
            word, pos, lemma = t.rsplit("/", 2) if t.count("/") == 2 else (t[0], t[2:4], t[0])
            rows.append((1, i, word, pos, lemma))
            i += 1
    return Corpus.from_tokens(spark.createDataFrame(rows, "doc_id long, tok_idx int, word string, pos_tag string, lemma string"))


@pytest.mark.parametrize("q", ["tea", "te? OR c*", '"a cup" AND NOT /x+/', "green NEAR/3 tea", "[lemma=tea]", "(a OR b) AND c", "drink >dobj tea"])
def test_plain_reads(q):
    plain.parse(q)


@pytest.mark.parametrize("q", ["the people", "", "(a", "a NEAR/0 b", "AND a", "a OR"])
def test_plain_rejects(q):
    with pytest.raises(plain.QueryError):
        plain.parse(q)


@pytest.mark.parametrize("q", ['[word="a"]', '[word="a" & pos!="b"] []{0,3} [lemma~"x.*"%c]+', '([word="a"] | [word="b"]{2}) [word in {"c","d"}]', 'within(<doc>, [word="a"] [word="b"])', 'where(year="1990" & (x!="y" | z={"p","q"}), [word="a"]*)', '[word="a"]{,4}', '[word="a"]{2,}'])
def test_pattern_round_trip(q):
    tree = cql.normalize(cql.parse(q))
    assert cql.normalize(cql.parse(cql.to_cql(tree))) == tree
    assert cql.from_builder(cql.to_builder(tree)) == tree
    assert cql.diagnose(q)["ok"]


@pytest.mark.parametrize("q", ['cql:[word="freedom"%d]', "cql:[]{300}", 'cql:where(year>="1990", [word="a"])', 'cql:[word>"a"]', 'cql:[lemma="freedom"', '[word="a"] [', 'a:[word="x"]', '[word!="a.*"]', 'within(<p>, [])', '[word="a"]{3,1}', '[word~"("]', '[word="a"] ]', '[word~"(a+)+"]', 'within(<s>, where(a="b", []))'])
def test_pattern_rejects(q):
    with pytest.raises(plain.QueryError):
        cql.parse(q)
    assert not cql.diagnose(q)["ok"]


def test_against_corpus(german):
    with pytest.raises(ValueError):
        matching.match(german, '[ent="PERSON"]')
    with pytest.raises(cql.PatternError):
        matching.match(german, '[pos="NOUN"]', closed=matching.tag_set(german))
    n = lambda q, **k: matching.match(german, q, **k).count()
    assert n('[lemma="gehen"]') == 4
    assert n('[pos="PPER"] [lemma="gehen"]') == 3
    assert n('[pos="V.*"] []{0,2} [pos="ADV"]') == 2
    assert n('[word="gehen" & pos!="VVFIN"]') == 1
    assert n('within(<doc>, [word="."] [word="du"])') == 1 and n('[word="\\."] [word="du"]') == 0
    assert n('([word="nach"] | [word="heute"]) []') == 3
    assert n("[]{2}") == 8 and n("[]{2}", overlapping=True) == 15


def test_node_offset(german):
    h = matching.match(german, '[] [lemma="gehen"] [word="nach"]').collect()
    assert len(h) == 2 and all(x.node_idx == x.start_idx + 1 for x in h)


def brute(pattern, masks):
    """Leftmost-longest by trying every end."""

    def ends(q, i):
        if isinstance(q, cql.Clause):
            return {i + 1} if i < len(masks) and masks[i] >> int(q.conds[0].values[0]) & 1 else set()
        if isinstance(q, cql.Alt):
            return set().union(*(ends(o, i) for o in q.options))
        if isinstance(q, cql.Seq):
            now = {i}
            for p in q.parts:
                now = set().union(*(ends(p, j) for j in now)) if now else set()
            return now
        out, now, k = ({i} if q.low == 0 else set()), {i}, 0
        while now and (q.high is None or k < q.high) and k <= len(masks):
            now = set().union(*(ends(q.of, j) for j in now))
            k += 1
            if k >= q.low:
                out |= now
        return out

    out, at = [], 0
    while at < len(masks):
        e = max((x for x in ends(pattern, at) if x > at), default=None)
        if e:
            out.append((at, e))
        at = e or at + 1
    return out


def test_automaton_is_brute_force():
    rnd = random.Random(3)

    def tree(depth):
        kind = rnd.randrange(4) if depth else 0
        if kind == 0:
            return cql.Clause((cql.Cond("word", "=", (str(rnd.randrange(3)),)),))
        if kind == 1:
            return cql.Seq(tuple(tree(depth - 1) for _ in range(rnd.randint(2, 3))))
        if kind == 2:
            return cql.Alt(tuple(tree(depth - 1) for _ in range(2)))
        low = rnd.randrange(3)
        return cql.Repeat(tree(depth - 1), low, rnd.choice([None, low + rnd.randrange(1, 3)]))

    for _ in range(300):
        q = tree(3)
        a = Automaton(q)
        names = [int(c.conds[0].values[0]) for c in a.clauses]
        bits = [rnd.randrange(8) for _ in range(rnd.randint(1, 12))]
        masks = [sum(1 << k for k, n in enumerate(names) if b >> n & 1) for b in bits]
        assert a.matches(masks) == brute(q, bits), (q, bits)


def test_near_is_brute_force(spark):
    rnd = random.Random(5)
    docs = [[rnd.choice("abc") for _ in range(rnd.randint(1, 15))] for _ in range(30)]
    c = Corpus.from_documents(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"))
    for a, b, n in (("a", "b", 1), ("a", "a", 2), ("b", "c", 3)):
        got = {(r.doc_id, r.start_idx) for r in plain.search(c, f"{a} NEAR/{n} {b}").collect()}
        want = {(i, k) for i, d in enumerate(docs) for k, x in enumerate(d) for y in ((b,) if x == a else ()) + ((a,) if x == b else ()) if any(d[j] == y for j in range(max(0, k - n), min(len(d), k + n + 1)) if j != k)}
        assert got == want


def test_fold_is_lower(spark):
    c = Corpus.from_documents(spark.createDataFrame([(1, "Straße STRASSE straße")], "doc_id long, text string"))
    assert plain.search(c, "straße").count() == 2 and plain.search(c, "strasse").count() == 1


def test_where_and_unknown_field(tea):
    assert matching.match(tea, 'where(register="blog", [word="tea"%c])').count() == 13
    assert matching.match(tea, 'where(register="blog" & date!={"2019-03-02"}, [word="tea"%c])').count() == 10
    with pytest.raises(cql.PatternError):
        matching.match(tea, 'where(year="1990", [word="tea"])')

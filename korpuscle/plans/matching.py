"""From a parsed pattern to hits, by the cheapest of three plans.

1. One clause: a filter.
2. A fixed sequence: ``lead`` of the clauses' columns over the segment, and a greedy pass over the
   starts of a segment where the sequence can overlap itself.
3. Anything else: clause bits per token, gathered per segment, segments without a needed clause dropped, and the
   automaton in one Arrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.corpus import Corpus, unit
from . import plain
from .cql import Alt, Clause, Cond, MetaJoin, MetaTest, PatternError, Repeat, Seq, Where, Within, fixed_sequences, is_regex, normalize, parse
from .nfa import Automaton

CLOSED = ("pos",)


def check(corpus: Corpus, clauses: list[Clause], closed: dict[str, set[str]] | None) -> None:
    """Unknown attributes are errors, and so are unknown literal values of a closed class."""
    for clause in clauses:
        for c in clause.conds:
            corpus.column(c.attr)
            if closed and c.attr in closed and not c.fold and c.op in ("=", "in") and not any(map(is_regex, c.values)):
                unknown = [v for v in c.values if v not in closed[c.attr]]
                if unknown and len(unknown) == len(c.values):
                    raise PatternError(f"unknown {c.attr} value {unknown[0]!r}; there are {', '.join(sorted(closed[c.attr]))}")


def tag_set(corpus: Corpus) -> dict[str, set[str]]:
    """The values of closed-class attributes: a small aggregate."""
    return {a: {r[0] for r in corpus.tokens.select(corpus.column(a)).distinct().collect()} for a in CLOSED if a in corpus.attributes()}


def cond_column(corpus: Corpus, c: Cond) -> Column:
    col = F.col(corpus.column(c.attr))
    if c.op == "!=":
        same = F.lower(col).isin([v.lower() for v in c.values]) if c.fold else col.isin(list(c.values))
        return F.coalesce(~same, F.lit(True))
    tests = []
    literal = [v for v in c.values if c.op == "in" or (c.op == "=" and not is_regex(v))]
    if literal:
        literal = [_plain(v) if c.op == "=" else v for v in literal]
        tests.append(F.lower(col).isin([v.lower() for v in literal]) if c.fold else col.isin(literal))
    tests += [col.rlike(f"{'(?iu)' if c.fold else '(?u)'}^(?:{v})$") for v in c.values if c.op == "~" or (c.op == "=" and is_regex(v))]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def _plain(v: str) -> str:
    out, skip = [], False
    for ch in v:
        if ch == "\\" and not skip:
            skip = True
            continue
        out.append(ch)
        skip = False
    return "".join(out)


def clause_column(corpus: Corpus, clause: Clause) -> Column:
    return reduce(Column.__and__, [cond_column(corpus, c) for c in clause.conds], F.lit(True))


def meta_column(corpus: Corpus, m) -> Column:
    if isinstance(m, MetaJoin):
        return reduce(Column.__and__ if m.op == "&" else Column.__or__, [meta_column(corpus, p) for p in m.parts])
    assert isinstance(m, MetaTest)
    if m.field not in corpus.meta:
        raise PatternError(f"no metadata field {m.field!r}; there are {', '.join(corpus.meta)}")
    same = F.coalesce(F.col(m.field).cast("string").isin(list(m.values)), F.lit(False))
    return same if m.op == "=" else ~same & F.col(m.field).isNotNull()


def clauses_of(q) -> list[Clause]:
    if isinstance(q, Clause):
        return [q]
    if isinstance(q, (Repeat, Within, Where)):
        return clauses_of(q.of)
    return [c for p in (q.parts if isinstance(q, Seq) else q.options) for c in clauses_of(p)]


def needed(q) -> list[Clause]:
    """Clauses that every match holds."""
    if isinstance(q, Clause):
        return [q] if q.conds else []
    if isinstance(q, Repeat):
        return needed(q.of) if q.low else []
    if isinstance(q, Seq):
        return list(dict.fromkeys(c for p in q.parts for c in needed(p)))
    return [c for c in needed(q.options[0]) if all(c in needed(o) for o in q.options[1:])] if isinstance(q, Alt) else []


def node_offset(q) -> int:
    """Offset of the first token with a fixed word or lemma, counted over parts of fixed length; else 0."""
    at = 0
    for p in q.parts if isinstance(q, Seq) else [q]:
        if isinstance(p, Clause):
            if any(c.attr in ("word", "lemma") and c.op in ("=", "in") and not any(map(is_regex, c.values)) for c in p.conds):
                return at
            at += 1
        elif isinstance(p, Repeat) and p.low == p.high and isinstance(p.of, Clause):
            at += p.low
        else:
            return 0
    return 0


def unwrap(corpus: Corpus, q) -> tuple[Corpus, str, object]:
    """The scoped corpus, the segment unit and the bare pattern."""
    if isinstance(q, Where):
        corpus = corpus.scope(corpus.docs.where(meta_column(corpus, q.meta)))
        q = q.of
    scope = "s"
    while isinstance(q, Within):
        scope, q = q.unit, q.of
    return corpus, scope, q


def can_overlap(seq: tuple[Clause, ...]) -> bool:
    """False only if no shift of the sequence fits itself: some pair of clauses has different literal values."""

    def apart(a: Clause, b: Clause) -> bool:
        lit = lambda c: not c.fold and c.op in ("=", "in") and not any(map(is_regex, c.values))
        return any(x.attr == y.attr and lit(x) and lit(y) and not set(x.values) & set(y.values) for x in a.conds for y in b.conds)

    n = len(seq)
    return any(not any(apart(seq[i + k], seq[i]) for i in range(n - k)) for k in range(1, n))


def match(corpus: Corpus, query, overlapping: bool = False, closed: dict[str, set[str]] | None = None) -> DataFrame:
    """Hits (doc_id, sent_id, start_idx, end_idx, node_idx) of a pattern; the unit is that of the start."""
    q = parse(query) if isinstance(query, str) else query
    corpus, scope, q = unwrap(corpus, normalize(q))
    if isinstance(q, (Within, Where)):
        raise PatternError("where() must wrap the whole query")
    check(corpus, clauses_of(q), closed)
    offset = node_offset(q)
    spelled = fixed_sequences(q, 1)
    if spelled and spelled[0]:
        return fixed(corpus, spelled[0], scope, offset, overlapping)
    return general(corpus, q, scope, offset, overlapping)


def _hit(start: Column, size: Column | int, offset: int) -> list[Column]:
    return [F.col("sent_id").cast("int").alias("sent_id"), start.cast("int").alias("start_idx"), (start + size).cast("int").alias("end_idx"), (start + offset).cast("int").alias("node_idx")]


def fixed(corpus: Corpus, seq: tuple[Clause, ...], scope: str, offset: int, overlapping: bool) -> DataFrame:
    tests = [clause_column(corpus, c) for c in seq]
    if len(seq) == 1:
        return corpus.tokens.where(tests[0]).select("doc_id", *_hit(F.col("tok_idx"), 1, 0))
    w, n = unit(scope), len(seq)
    named = corpus.tokens.select("doc_id", "sent_id", "tok_idx", *[t.alias(f"_p{k}") for k, t in enumerate(tests)])
    ahead = [F.lead(f"_p{k}", k).over(w) for k in range(1, n)]
    found = named.select("doc_id", "sent_id", "tok_idx", reduce(Column.__and__, ahead, F.col("_p0")).alias("_hit")).where("_hit")
    if overlapping or not can_overlap(seq):
        return found.select("doc_id", *_hit(F.col("tok_idx"), n, offset))
    keys = ["doc_id", "sent_id"] if scope == "s" else ["doc_id"]
    starts = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "sent_id"))).alias("all"))
    greedy = f"""aggregate(all, named_struct('next', -1, 'kept', cast(array() as array<struct<tok_idx:int,sent_id:int>>)),
        (a, x) -> if(x.tok_idx >= a.next, named_struct('next', x.tok_idx + {n}, 'kept', array_append(a.kept, x)), a), a -> a.kept)"""
    kept = starts.select("doc_id", F.explode(F.expr(greedy)).alias("x")).select("doc_id", "x.tok_idx", "x.sent_id")
    return kept.select("doc_id", *_hit(F.col("tok_idx"), n, offset))


_PLACES = ("sent_id", "start_idx", "end_idx", "node_idx")


def general(corpus: Corpus, q, scope: str, offset: int, overlapping: bool) -> DataFrame:
    automaton = Automaton(q)
    if len(automaton.clauses) > 62:
        raise PatternError("a pattern has at most 62 different clauses")
    bits = reduce(Column.__add__, [F.when(clause_column(corpus, c), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(automaton.clauses)])
    must = [automaton.clauses.index(c) for c in needed(q)]
    keys = ["doc_id", "sent_id"] if scope == "s" else ["doc_id"]
    marked = corpus.tokens.select("doc_id", "sent_id", "tok_idx", bits.alias("mask"))
    segments = marked.groupBy(*keys).agg(F.bit_or("mask").alias("any"), F.array_sort(F.collect_list(F.struct("tok_idx", "mask", "sent_id"))).alias("toks"))
    for k in must:  # a segment without a needed clause has no match
        segments = segments.where(F.col("any").bitwiseAND(1 << k) != 0)
    ident = corpus.tokens.schema["doc_id"].dataType  # numbers or strings
    schema = pa.schema([("doc_id", to_arrow_type(ident)), *[(c, pa.int32()) for c in _PLACES]])
    arrays = segments.select("doc_id", F.col("toks.mask").alias("mask"), F.col("toks.tok_idx").alias("idx"), F.col("toks.sent_id").alias("sent"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, masks, idx, sent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, sent[s], idx[s], idx[e - 1] + 1, idx[s] + offset) for s, e in automaton.matches(masks, overlapping)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return arrays.mapInArrow(run, f"doc_id {ident.simpleString()}, " + ", ".join(f"{c} int" for c in _PLACES))


_CO = re.compile(r"\s*co\((.*)\)\s*$", re.I | re.S)
_ARGUMENT = re.compile(r'(\w+)\s*=\s*("(?:\\.|[^"\\])*"|[^,"]*)')


def co_query(query: str) -> dict | None:
    """The arguments of ``co(term=.., collocate=a|b, window=, within_sentence=, attribute=)``; None for other queries."""
    m = _CO.match(query)
    if not m:
        return None
    bare = lambda v: v[1:-1] if v[:1] == '"' else v.strip()
    given = {k.lower(): bare(v) for k, v in _ARGUMENT.findall(m[1])}
    literal = lambda v: re.sub(r"\\(.)", r"\1", v).strip()
    words = [literal(x) for x in re.split(r"(?<!\\)\|", given.get("collocate") or given.get("collocates") or "")]
    term, words = literal(given.get("term", "")), [*dict.fromkeys(w for w in words if w)]
    if not term or not words:
        raise PatternError("co() needs a term and a collocate")
    size = given.get("window") or given.get("w") or "5"
    inside = given.get("within_sentence") or given.get("within") or "true"
    return {
        "node": term, "collocates_": words, "window": int(size) if size.isdigit() and int(size) else 5, "within": "s" if inside.lower() in ("1", "true", "yes") else "doc",
        "attr": "lemma" if (given.get("attribute") or given.get("attr") or "").lower() == "lemma" else "word",
    }


def hits(corpus: Corpus, query: str, case_sensitive: bool = False, overlapping: bool = False, similar: Callable[[str, int], list[str]] | None = None) -> DataFrame:
    """Hits of a query in either language, or of a ``co()`` query.

    ``similar(word, k)`` lists the words that ``sim("word")`` stands for. Tags that the corpus does not have are an error here.
    """
    from ..operators import collocation, vectors

    co = co_query(query)
    if co is not None:
        return collocation.co_occurrence(corpus, **co)
    if "sim" in query and similar is not None:
        query = vectors.expand_similar(query, similar)
    if plain.is_pattern(query):
        tree = parse(query)
        tagged = any(c.attr in CLOSED for clause in clauses_of(normalize(tree)) for c in clause.conds)
        return match(corpus, tree, overlapping, tag_set(corpus) if tagged else None)
    return plain.search(corpus, query, case_sensitive)


def type_count(corpus: Corpus, attribute: str, regex: str) -> DataFrame:
    """Tokens whose attribute matches a regex, counted on the lexicon, without positions."""
    return corpus.lexicon(attribute).where(F.col("value").rlike(f"(?u)^(?:{regex})$")).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n_hits"), F.count("*").alias("n_types"))

"""Plain search: words, wildcards, regexes, phrases, attributes, Boolean operators, NEAR, dependencies.

Precedence, loosest first: OR, AND, NOT, then NEAR and the dependency arrows. A query denotes token
positions, so every node becomes a boolean column of the token table; NEAR is a window count and needs
no join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wildcard_regex
from ..operators.corpus import Corpus, by_document


class QueryError(ValueError):
    """A query that cannot be read or does not fit the corpus."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Wild:
    pattern: str


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Attr:
    name: str
    value: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Near:
    left: object
    right: object
    n: int


@dataclass(frozen=True)
class Dependency:
    head: object
    rel: str
    dependent: object


_LEX = re.compile(
    r"""\s*(?:(?P<phrase>"[^"]*")|(?P<regex>/(?:\\.|[^/\\])+/)|(?P<attr>\[\s*\w+\s*=\s*(?:"[^"]*"|[^\]\s"]+)\s*\])
    |(?P<near>NEAR/\d+)|(?P<op>AND\b|OR\b|NOT\b)|(?P<open>\()|(?P<close>\))|(?P<dep>[<>][\w:]+)|(?P<word>[^\s()"\[\]<>]+))""",
    re.X,
)


def lex(query: str) -> list[tuple[str, str]]:
    out, at, query = [], 0, query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"cannot read {query[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
        while at < len(query) and query[at].isspace():
            at += 1
    return out


class _Parser:
    def __init__(self, query: str):
        self.toks, self.at = lex(query), 0
        if not self.toks:
            raise QueryError("the query is empty")

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def parse(self):
        out = self.either()
        kind, text = self.peek()
        if kind != "end":
            if kind in ("word", "phrase", "regex", "attr"):
                words = " ".join(t for k, t in self.toks if k == "word")
                raise QueryError(f'a bare sequence is no query; write "{words}" or a pattern such as cql:' + " ".join(f'[word="{w}"%c]' for w in words.split()))
            raise QueryError(f"{text!r} stands where the query should end")
        return out

    def either(self):
        out = self.both()
        while self.peek() == ("op", "OR"):
            self.take()
            out = Or(out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.peek() == ("op", "AND"):
            self.take()
            out = And(out, self.negated())
        return out

    def negated(self):
        if self.peek() == ("op", "NOT"):
            self.take()
            return Not(self.negated())
        return self.tied()

    def tied(self):
        out = self.atom()
        while self.peek()[0] in ("near", "dep"):
            kind, text = self.take()
            right = self.atom()
            if kind == "near":
                n = int(text[5:])
                if n < 1:
                    raise QueryError("NEAR needs a distance of 1 or more")
                out = Near(out, right, n)
            else:
                out = Dependency(out, text[1:], right) if text[0] == ">" else Dependency(right, text[1:], out)
        return out

    def atom(self):
        kind, text = self.take()
        if kind == "open":
            out = self.either()
            if self.take()[0] != "close":
                raise QueryError("a parenthesis is not closed")
            return out
        if kind == "phrase":
            words = tuple(text[1:-1].split())
            if not words:
                raise QueryError("a phrase needs words")
            return Phrase(words) if len(words) > 1 else Term(words[0])
        if kind == "regex":
            return Regex(text[1:-1])
        if kind == "attr":
            name, value = text[1:-1].split("=", 1)
            return Attr(name.strip(), value.strip().strip('"'))
        if kind == "word":
            return Wild(text) if "*" in text or "?" in text else Term(text)
        raise QueryError(f"{text or 'the end'!r} stands where a term should")


def parse(query: str):
    return _Parser(query).parse()


def is_pattern(query: str) -> bool:
    """True if a query is written in the pattern language."""
    q = query.strip()
    return q.startswith("cql:") or bool(re.match(r"(?:\(\s*)*(\[\s*\]|\[[^\]]*\"[^\"]*\"|within\(|where\()", q))


class _Evaluator:
    """Adds one boolean column for each node."""

    def __init__(self, corpus: Corpus, case_sensitive: bool):
        self.corpus, self.case = corpus, case_sensitive
        self.df, self.n = corpus.tokens, 0

    def named(self, column) -> str:
        self.n += 1
        name = f"_q{self.n}"
        self.df = self.df.withColumn(name, F.coalesce(column, F.lit(False)))
        return name

    def same(self, word: str):
        return F.col("word") == word if self.case else F.col("word_lc") == word.lower()

    def visit(self, q) -> str:
        if isinstance(q, Term):
            return self.named(self.same(q.word))
        if isinstance(q, Wild):
            return self.named(F.col("word").rlike(wildcard_regex(q.pattern)) if self.case else F.col("word_lc").rlike(wildcard_regex(q.pattern.lower())))
        if isinstance(q, Regex):
            return self.named(F.col("word").rlike(f"(?iu)^(?:{q.pattern})$"))
        if isinstance(q, Attr):
            return self.named(F.col(self.corpus.column(q.name)) == q.value)
        if isinstance(q, Phrase):
            w = by_document()
            test = self.same(q.words[0])
            for k, word in enumerate(q.words[1:], 1):
                test = test & (F.lead("word", k).over(w) == word if self.case else F.lead("word_lc", k).over(w) == word.lower()) & (F.lead("tok_idx", k).over(w) == F.col("tok_idx") + k)
            return self.named(test)
        if isinstance(q, Not):
            return self.named(~F.col(self.visit(q.of)))
        if isinstance(q, (And, Or)):
            a, b = self.visit(q.left), self.visit(q.right)
            return self.named(F.col(a) & F.col(b) if isinstance(q, And) else F.col(a) | F.col(b))
        if isinstance(q, Near):
            a, b = (F.col(self.visit(x)) for x in (q.left, q.right))
            frame = by_document().rowsBetween(-q.n, q.n)
            others = lambda x: F.sum(x.cast("int")).over(frame) - x.cast("int") > 0
            return self.named((a & others(b)) | (b & others(a)))
        if isinstance(q, Dependency):
            if "head_idx" not in self.df.columns:
                raise QueryError("the corpus has no dependency layer")
            head, dep = self.visit(q.head), self.visit(q.dependent)
            heads = self.df.where(F.col(dep) & (F.col("rel") == q.rel) & (F.col("head_idx") != F.col("tok_idx")))
            heads = heads.select("doc_id", F.col("head_idx").alias("tok_idx"), F.lit(True).alias("_has")).distinct()
            self.df = self.df.join(heads, ["doc_id", "tok_idx"], "left")
            name = self.named(F.col(head) & F.col("_has"))
            self.df = self.df.drop("_has")
            return name
        raise QueryError(f"no such query node: {q!r}")


def search(corpus: Corpus, query: str, case_sensitive: bool = False) -> DataFrame:
    """Hits (doc_id, sent_id, start_idx, end_idx, node_idx) of a plain query.

    A phrase counts at every start and its hit spans its words; everything else is one token.
    """
    q = parse(query)
    e = _Evaluator(corpus, case_sensitive)
    if isinstance(q, Phrase):  # only tokens that are one of its words are put in order
        e.df = e.df.where(reduce(Column.__or__, [e.same(w) for w in q.words]))
    name = e.visit(q)
    size = len(q.words) if isinstance(q, Phrase) else 1
    found = e.df.where(F.col(name))
    return found.select("doc_id", "sent_id", F.col("tok_idx").alias("start_idx"), (F.col("tok_idx") + size).alias("end_idx"), F.col("tok_idx").alias("node_idx"))

"""One object for users: every analysis of a corpus by name, scopes and queries as plain values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame

from .operators import collocation, counting, deps, dispersion, keyness, kwic, ranking, scopes
from .operators.corpus import Corpus
from .plans import cql, matching


class Analysis:
    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def scoped(self, scope: DataFrame | dict[str, Any] | None) -> Corpus:
        """The corpus, or its part in a docset or a metadata filter."""
        if scope is None:
            return self.corpus
        return self.corpus.scope(scopes.docset_from_meta(self.corpus, scope) if isinstance(scope, dict) else scope)

    def hits(self, query: str, scope=None, case_sensitive: bool = False) -> DataFrame:
        return matching.hits(self.scoped(scope), query, case_sensitive)

    def count(self, query: str, scope=None) -> int:
        return self.hits(query, scope).count()

    def kwic(self, query: str, ctx: int = 5, scope=None, sort: list[str] | None = None, sample: tuple[int, int] | None = None) -> DataFrame:
        c = self.scoped(scope)
        rows = kwic.lines(c, matching.hits(c, query), ctx)
        if sample is not None:
            rows = kwic.sample(rows, *sample)
        if sort and any(s.startswith("meta:") for s in sort):
            rows = rows.join(c.docs.select("doc_id", *c.meta), "doc_id")
        return kwic.ordered(rows, sort) if sort else rows

    def diagnose(self, query: str) -> dict:
        return cql.diagnose(query)

    def frequency(self, attr: str = "word", scope=None, stopwords: list[str] | None = None, pos: str | None = None) -> DataFrame:
        docset = None if scope is None else self.scoped(scope).docs
        return counting.frequency(self.corpus, attr, docset, stopwords, pos)

    def frequency_contrast(self, target: Column, reference: Column, min_freq: int = 5) -> DataFrame:
        return counting.frequency_contrast(self.corpus, target, reference, min_freq)

    def ngrams(self, n: int, scope=None, min_freq: int = 1) -> DataFrame:
        return counting.ngrams(self.scoped(scope), n, min_freq)

    def ngram_contrast(self, target: Column, reference: Column, n: int = 2, min_freq: int = 5) -> DataFrame:
        return counting.ngram_contrast(self.corpus, target, reference, n, min_freq)

    def collocates(self, node: str, window: int = 5, within: str = "s", attr: str = "word", min_freq: int | None = None, sort_by: str = "logdice", limit: int = 50, scope=None) -> DataFrame:
        c = self.scoped(scope)
        of = matching.hits(c, node) if matching.plain.is_pattern(node) or " " in node else node
        return collocation.displayed(collocation.ranked(collocation.collocates(c, of, window, within, attr, min_freq, with_lrc=True), sort_by, limit))

    def co_kwic(self, node: str, collocates: list[str], window: int = 5, ctx: int = 5) -> DataFrame:
        return kwic.lines(self.corpus, collocation.co_occurrence(self.corpus, node, collocates, window), ctx)

    def network(self, node: str, depth: int = 2, nodes: int = 40) -> DataFrame:
        return collocation.network(self.corpus, node, depth, nodes)

    def collocation_contrast(self, node: str, target: Column, reference: Column, window: int = 5) -> DataFrame:
        return collocation.contrast(self.corpus, node, target, reference, window)

    def keyness(self, target: Column, reference: Column | None = None, min_freq: int = 5) -> DataFrame:
        return keyness.keyness(self.corpus, target, reference, min_freq)

    def context_keyness(self, node: str, window: int = 5) -> DataFrame:
        return collocation.context_keyness(self.corpus, node, window)

    def trend(self, query: str, field: str, granularity: str = "year") -> DataFrame:
        return dispersion.trend(self.corpus.docs, self.hits(query), field, granularity)

    def dispersion(self, query: str, scope=None) -> DataFrame:
        c = self.scoped(scope)
        return dispersion.dispersion(c, matching.hits(c, query))

    def word_sketch(self, node: str, min_pairs: int = 3) -> DataFrame:
        return deps.sketch(self.corpus, node, min_pairs)

    def sketch_diff(self, a: str, b: str, min_pairs: int = 3) -> DataFrame:
        return deps.sketch_difference(deps.sketch(self.corpus, a, min_pairs), deps.sketch(self.corpus, b, min_pairs))

    def lexical_diversity(self, scope=None, sttr_window: int = 1000, mattr_window: int = 500) -> DataFrame:
        c = self.scoped(scope)
        return dispersion.type_token(c).crossJoin(dispersion.sttr(c, sttr_window)).crossJoin(dispersion.mattr(c, mattr_window))

    def search_docs(self, terms: list[str], metric: str = "bm25", top_n: int = 20) -> DataFrame:
        return ranking.search_documents(self.corpus, terms, metric, top_n)

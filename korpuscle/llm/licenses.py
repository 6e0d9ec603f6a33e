"""License scans: base phrases, and an exact set-similarity join of text blocks with templates.

Everything here is DataFrame expressions. Words are runs of characters other than ASCII ones that are
neither digit nor lower-case letter, after lower-casing A-Z; line breaks and comment signs only part words.

A template is a notice with ``s`` distinct words. A short one (``SHORT`` distinct words at most)
needs all of them, side by side; a longer one needs ceil(``THETA`` * s) of them among
``width`` consecutive words, width being its length divided by THETA. Its telling words
(``TELLING``: names that part one license from another) are needed in any case. A text block is
the ``width`` words from any word of the template on. Of two templates with different labels, the words of one within the
other's, a block that also has all the other words of the greater one counts for the greater one alone.

The join orders the words of all templates by the count of all documents that hold them, rarest first. It meets
parts of documents, 2 * ``span`` words from every span-th word on, so that each block lies within one of
them; a part is the set of template words it holds, in that order. A block that holds ``need`` of s words holds one of the
first s - need + 1, so parts meet templates on those words alone (prefix filter). A part with m < need
words cannot match (length filter), and neither can one whose first such word stands at place i
of the part and p of the template if min(m - i, s - p) < need (positional filter). The blocks of what is left are counted exactly.

Templates are a parameter of fixed size; the order of their words comes from counts over
all documents. Narrow rows are written once to the checkpoint folder, so a document's number stays the same.
Defined cases: a null text counts as empty and has no words, places or
labels; a very long text is cut in parts of bounded size; equal shares need no order, for all labels that match are given;
repeated rows give repeated results; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by "
    "the free software foundation either version {} of the license or at your option any later version"
)
#: Public license notices, by label.
TEMPLATES = {
    "agpl": ["gnu affero general public license", _GNU.format("affero general", "3")],
    "apache": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "boost": ["distributed under the boost software license version 1.0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ],
    "epl": ["made available under the terms of the eclipse public license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license",
        _GNU.format("general", "2"), _GNU.format("general", "3"),
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "lgpl": ["gnu lesser general public license", _GNU.format("lesser general", "2.1"), _GNU.format("lesser general", "3")],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "rights-reserved": ["all rights reserved"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose",
    ],
}
_CC_WORDS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
for _kind in ("by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa"):
    _short, _long = _kind.replace("-", " "), " ".join(_CC_WORDS[x] for x in _kind.split("-"))
    TEMPLATES[f"cc-{_kind}"] = [f"cc {_short} {v}" for v in ("2.0", "3.0", "4.0")] + [
        f"creative commons {_long} 4.0 international", f"creative commons {_long} 3.0 unported", f"creative commons {_long} 2.0 generic",
    ]

#: Words that part one license from another; a template that has one needs it.
TELLING = frozenset(
    "affero apache attribution boost by cc commons creative domain eclipse general gnu isc lesser mit mozilla nc nd noncommercial noderivatives "
    "rights sa sharealike unencumbered zlib".split()
)
THETA = 0.85
#: A template of this many distinct words, or fewer, needs all of them.
SHORT = 10
_OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased.

    ``lower`` takes all letters, faster than A-Z alone, and parts the same words: the one other letter that
    becomes an ASCII word is the Kelvin sign, which gives way to the Ohm sign first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u2126")))
    return F.array_remove(F.split(low, _OTHERS), "")


def count_of(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def words_before(flat_text: Column) -> Column:
    """Words in text whose words stand between two blanks each."""
    s = F.trim(flat_text)
    return F.when(s == "", F.lit(0)).otherwise((F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")


class Template:
    """A notice: its distinct words, how many a block needs, of how many words a block is, and which it must or must not hold."""

    def __init__(self, number: int, label: str, text: str, theta: float, short: int):
        every = re.findall(r"[a-z0-9]+", text)
        self.number, self.label, self.words = number, label, sorted(set(every))
        whole = len(self.words) <= short
        self.need = len(self.words) if whole else math.ceil(theta * len(self.words) - 1e-9)
        self.width = len(every) if whole else math.ceil(len(every) / theta - 1e-9)
        self.telling = [w for w in self.words if w in TELLING]
        self.rivals: list[list[str]] = []


def template_rows(templates: dict[str, list[str]], theta: float = THETA, short: int = SHORT) -> list[Template]:
    out: list[Template] = []
    for label in sorted(templates):
        for text in templates[label]:
            out.append(Template(len(out), label, text, theta, short))
    out = [t for t in out if t.words]
    for t in out:
        more = {tuple(sorted(set(o.words) - set(t.words))) for o in out if o.label != t.label and set(t.words) < set(o.words)}
        t.rivals = [list(x) for x in sorted(more)]
    return out


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The given words, those in the fewest documents first; ties by the word."""
    held = F.array_intersect(words_of(F.col("text").cast("string")), F.array(*[F.lit(w) for w in words]))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    known = {r["word"]: r["count"] for r in counts.collect()}  # at most the templates' words
    return sorted(words, key=lambda w: (known.get(w, 0), w))


def positional(words: Column, at: Column, size: Column, place: Column, need: Column) -> Column:
    """Whether the words from a shared one on, it included, suffice on both sides."""
    return F.least(words - at, size - place) >= need


def part_hits(words: Column, order: list[str], span: int, least: int) -> Column:
    """Parts of a document, each the codes place * len(order) + rank of its template words, by place; those with too few go."""
    rank = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))])
    code = lambda w, i: i * len(order) + rank[w]
    part = lambda k: F.array_compact(F.transform(F.slice(words, k * span + 1, 2 * span), code))
    return F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / span).cast("int")), part), lambda hits: F.size(hits) >= least)


def part_matches(parts: DataFrame, rows: list[Template], order: list[str], span: int) -> DataFrame:
    """(row, label, share) for each block of the parts (row, hits) and template that match."""
    spark = parts.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    index, first = [], set()
    for t in rows:
        ranked = sorted(rank[w] for w in t.words)
        prefix = ranked[: len(ranked) - t.need + 1]
        first.update(prefix)
        own = (t.label, ranked, prefix, [rank[w] for w in t.telling], [[rank[w] for w in x] for x in t.rivals], t.need, t.width)
        index += [(r, place, *own) for place, r in enumerate(prefix)]
    ddl = "rank int, place int, label string, wanted array<int>, prefix array<int>, telling array<int>, rivals array<array<int>>, need int, width int"
    known = spark.createDataFrame(index, ddl)
    ranks = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.pmod(x, F.lit(len(order))))))
    # only words that start a prefix are dealt out, and a pair goes on at the first of them
    keyed = parts.select("row", "hits", ranks.alias("ranks")).select("row", "hits", "ranks", F.posexplode("ranks").alias("at", "rank")).where(F.col("rank").isin(sorted(first)))
    met = keyed.join(F.broadcast(known), "rank").where(F.element_at(F.array_intersect("ranks", "prefix"), 1) == F.col("rank"))
    met = met.where(positional(F.size("ranks"), F.col("at"), F.size("wanted"), F.col("place"), F.col("need")))

    def block(start: Column, nth: Column) -> Column:
        """Share of the template that the block from a hit on holds; 0 if it does not match."""
        end = (F.floor(start / len(order)) + F.col("width")) * len(order)
        held = F.transform(F.filter(F.slice("hits", nth + 1, F.col("width")), lambda x: x < end), lambda x: F.pmod(x, F.lit(len(order))))
        shared = F.size(F.array_intersect("wanted", held))
        others = F.exists("rivals", lambda more: F.size(F.array_except(more, held)) == 0)
        ok = (shared >= F.col("need")) & (F.size(F.array_except("telling", held)) == 0) & ~others
        return F.when(ok, shared / F.size("wanted")).otherwise(F.lit(0.0))

    starts = F.transform("hits", lambda x, i: F.when((x < span * len(order)) & F.array_contains("wanted", F.pmod(x, F.lit(len(order)))), block(x, i)).otherwise(F.lit(0.0)))
    return met.select("row", "label", F.array_max(starts).alias("share")).where("share > 0")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, theta: float = THETA, short: int = SHORT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is the largest share of a template that a matching block holds; a base phrase counts 1.
    """
    rows = template_rows(TEMPLATES if templates is None else templates, theta, short)
    order = word_order(docs, sorted({w for t in rows for w in t.words})) if rows else []
    rank = {w: i for i, w in enumerate(order)}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))

    found = [(label, f"  {phrase.replace(' ', '  ')}  ") for phrase, label in PHRASES.items()]
    f = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    has = [F.array_contains("words", phrase.split()[-1]) & F.contains(f, F.lit(what[1:-1])) for phrase, (_, what) in zip(PHRASES, found, strict=True)]
    n_words = F.size("words").cast("long")
    counts = [F.when(h, count_of(f, what[1:-1])).otherwise(F.lit(0)) for h, (_, what) in zip(has, found, strict=True)]
    starts = [F.when(h, words_before(F.substring_index(f, what[1:-1], 1))) for h, (_, what) in zip(has, found, strict=True)]
    ends = [F.when(h, n_words - words_before(F.substring_index(f, what[1:-1], -1)) - len(what.split())) for h, (_, what) in zip(has, found, strict=True)]
    base = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (label, _) in zip(counts, found, strict=True)]))
    none = F.array().cast("array<array<int>>")
    span = max((t.width for t in rows), default=1)
    if rows:
        starting = {w for t in rows for w in sorted(t.words, key=rank.__getitem__)[: len(t.words) - t.need + 1]}
        could = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(starting)]))
        parts = F.when(could, part_hits(F.col("words"), order, span, min(t.need for t in rows))).otherwise(none)
    else:
        parts = none
    # kept: no text, and hits of documents with a word that starts a prefix alone
    own = cut(
        text.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"),
            F.array_min(F.array(*starts)).alias("first_word"), F.array_max(F.array(*ends)).alias("last_word"), base.alias("base"), parts.alias("parts"),
        )
    )
    bare = F.array().cast("array<string>")
    met = own.where(F.size("parts") > 0)
    if rows:
        by_row = part_matches(met.select("row", F.explode("parts").alias("hits")), rows, order, span).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    else:
        by_row = met.select("row", bare.alias("more"), F.lit(0.0).alias("share"))
    out = met.drop("parts").join(by_row, "row", "left").unionByName(own.where(F.size("parts") == 0).drop("parts").withColumns({"more": bare, "share": F.lit(0.0)}))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", bare))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

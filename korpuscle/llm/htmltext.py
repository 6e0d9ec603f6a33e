"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks, runs of text between block-level tags, each with its element, which knows what
all its ancestors tell (their tags, and the kinds of words in their class and id names). Features of a block (its tag, ancestors, kinds, length,
share of linked text, punctuation, the same of its neighbours, and the density of the element around it) score the labels "main" and "other"; transition weights tie neighbours together.
The weights are trained on labelled pages (``labelled_pages``: layouts of many kinds, two in five of them without
telling names, with the label of every block) by gradient ascent on the likelihood, and Viterbi finds the best labels of a page.

Time and memory are in proportion to the length of a page, whatever its tags: nothing is searched for twice that
is not there, and an element holds no copy of its ancestors.

Defined cases: a null or empty page, or one without main blocks, gives the empty string;
tags never closed, or closed twice, are read as far as they go; a tag that another one starts in, or that the page breaks off in, is text; very long
and very deep pages are read whole; of equally likely labels a block is "other";
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of, to_batch

# Fixed values of HTML: elements without content, with content that is no text, and in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())

_STOPS_P = CLOSES_P - {"p"}

_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_TAG = re.compile(r"</?[a-zA-Z][^\s/><]*")
_BREAK = re.compile("[<>\"']")

#: Words in class and id names, by what they tell.
MARKS = {
    "main": "article content post entry story body main text prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay privacy disclaimer",
    "edge": "header footer masthead topbar bottom copyright colophon legal",
    "side": "sidebar side aside widget related recommended recommendations popular trending more teaser",
    "talk": "comment comments reply replies disqus discussion respond reviews",
    "form": "form search login signup subscribe newsletter share social sharing",
}
_KIND = {w: k for k, ws in MARKS.items() for w in ws.split()}
_AREAS = frozenset("article main section nav header footer aside form table ul ol dl blockquote figure pre button dialog menu fieldset address details".split())


class Element:
    """An open tag: what it and its ancestors tell, and the text of the blocks right in it or in its children."""

    __slots__ = ("areas", "chars", "kinds", "linked", "parent", "points", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.areas: frozenset[str] = parent.areas if parent else frozenset()
        self.kinds: frozenset[str] = parent.kinds if parent else frozenset()
        if tag in _AREAS and tag not in self.areas:
            self.areas |= {tag}
        if attributes and not (own := kinds_of(attributes) if len(attributes) < 500 else kinds_in(attributes)) <= self.kinds:
            self.kinds |= own
        self.chars = self.linked = self.points = 0


class Block:
    __slots__ = ("element", "linked", "points", "text")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element
        self.points = sum(map(text.count, ".,;:!?"))
        for e in (element, element.parent):
            if e is not None:
                e.chars, e.linked, e.points = e.chars + len(text), e.linked + linked, e.points + self.points


def kinds_in(attributes: str) -> frozenset[str]:
    """The kinds of the words in class, id and role."""
    return frozenset(_KIND[w] for v in _NAMES.findall(attributes) for w in _WORD.findall(v.lower()) if w in _KIND)


kinds_of = lru_cache(maxsize=10_000)(kinds_in)


class Finder:
    """Searches a page; what is not there after one place is not looked for after a later one."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def closing(self, name: str, at: int) -> int:
        """The end of the next closing tag of a name, or -1."""
        if name in self.gone:
            return -1
        m = _closing(name).search(self.page, at)
        if m is None:
            self.gone.add(name)
            return -1
        return m.end()

    def tag_end(self, at: int) -> int:
        """The place of the > of a tag, outside quotes; -1 if another tag starts before, or -2 if the page ends."""
        while m := _BREAK.search(self.page, at):
            c = m[0]
            if c == ">":
                return m.start()
            if c == "<":
                return -1
            at = self.find(c, m.end()) + 1
            if not at:
                return -2
        return -2


@lru_cache(maxsize=100)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def pieces(page: str):
    """Texts as (None, text, False) and tags as (name, attributes, closes), in page order, without comments and declarations."""
    finder, at, n = Finder(page), 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield None, page[at:start], False
        if start == n:
            return
        if page.startswith("<!--", start):
            end = finder.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[start + 1 : start + 2] in ("!", "?") and start + 1 < n:
            end = finder.find(">", start + 2)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, start)
        end = finder.tag_end(m.end()) if m else -1
        if end < 0:  # no tag: text; what an open end leaves is text as a whole
            at = start + 1 if end == -1 else n
            yield None, page[start:at], False
            continue
        closes = page[start + 1] == "/"
        name = page[start + 1 + closes : m.end()].lower()
        attributes, at = page[m.end() : end], end + 1
        if name in RAW and not closes and name != "head" and not attributes.endswith("/"):
            after = finder.closing(name, at)
            at = after if after >= 0 else n if name in ("script", "style", "template") else at
            continue
        yield name, attributes, closes


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in page order, with references decoded and white space joined."""
    out: list[Block] = []
    stack: list[Element] = [Element("", "", None)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    run: list[str] = []
    linked, in_link = 0, 0

    def close_block() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                out.append(Block(text, linked, stack[-1]))
            run.clear()
        linked = 0

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def pop_to(names, stop=()) -> None:
        """Closes the innermost element of these names, with all inside it, unless a stop is further in."""
        k = last(names)
        if k and k > last(stop):
            while len(stack) > k:
                places[stack.pop().tag].pop()

    for name, piece, closes in pieces(html or ""):
        if name is None:
            run.append(piece)
            if in_link:
                linked += len(piece)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closes else 1
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in RAW and not closes:
            if name == "head":
                close_block()
            continue
        close_block()
        if name in VOID or name in RAW:
            continue
        in_link = 0
        if closes:
            pop_to((name,))
            continue
        if name in CLOSES_P:
            pop_to(("p",), _STOPS_P)
        if name in SELF_CLOSING:
            pop_to(SELF_CLOSING[name], LISTS)
        places[name].append(len(stack))
        stack.append(Element(name, piece, stack[-1]))
    close_block()
    return out


# -- features --------------------------------------------------------------------------

_TOLD = frozenset("nav header footer aside form button menu dialog".split())


def of_text(size: int, linked: int, points: int) -> str:
    """Length, share of links and of punctuation, in few steps."""
    return f"{min(size.bit_length() // 2, 5)},{min(int(3 * linked / max(size, 1)), 2)},{min(int(60 * points / max(size, 1)), 2)}"


def features(blocks: list[Block], k: int) -> list[str]:
    block, n = blocks[k], len(blocks)
    text, e = block.text, block.element
    size, around = len(text), e.parent or e
    out = [
        "bias", f"tag={e.tag}", f"size={min(size.bit_length(), 10)}", f"links={min(int(block.linked / size * 4), 4)}", f"points={min(int(100 * block.points / size), 6)}",
        f"place={'first' if k == 0 else 'last' if k == n - 1 else 'mid'}", f"ends={text[-1] in '.!?…'}",
        f"before={of_text(len(blocks[k - 1].text), blocks[k - 1].linked, blocks[k - 1].points) if k else ''}",
        f"after={of_text(len(blocks[k + 1].text), blocks[k + 1].linked, blocks[k + 1].points) if k + 1 < n else ''}",
        f"own={of_text(e.chars, e.linked, e.points)}", f"around={of_text(around.chars, around.linked, around.points)}", f"outer={around.tag}",
    ]
    form = of_text(size, block.linked, block.points)
    told = "told" if _TOLD & e.areas or e.kinds - {"main"} else "untold"
    out += [f"form={e.tag},{form}", f"form={told},{form}", f"{told},{e.tag}"]
    out += [f"in={t}" for t in e.areas]
    out += [f"mark={x}" for x in e.kinds]
    out += [f"near={x}" for x in e.kinds - (around.kinds if around is not e else frozenset())]
    if "©" in text:
        out.append("copyright")
    return out


# -- labelled pages --------------------------------------------------------------------


def labelled_pages(count: int = 800, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages in many layouts with the label of every block, true for main text."""
    rng = random.Random(seed)
    syllables = "ba ne ti ro lu sa mi ko de fa ri no pe la tu so ha gi we yo".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a, b: words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", "***", ""])
    out = []
    for _ in range(count):
        html, marks = ["<!DOCTYPE html><html><head><title>", words(2, 8), "</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body>"], []

        def add(piece: str, *label: bool, html=html, marks=marks) -> None:
            html.append(piece)
            marks.extend(label)

        def links(open_tag: str, close_tag: str, a: int, b: int, add=add) -> None:
            k = rng.randint(a, b)
            add(open_tag + "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>" + close_tag, *[False] * k)

        bare = rng.random() < 0.4  # a layout of divs without telling names

        def plain(add=add, links=links) -> None:
            """What its form alone tells to be no main text."""
            kind = rng.randrange(5)
            name = rng.choice(["", "", f' class="{word()}"', f' id="c{rng.randint(1, 99)}"', ' class="row col wrap"'])
            if kind == 0:
                links(f"<div{name}>", "</div>", 2, 8)
            elif kind == 1:
                k = rng.randint(2, 7)
                add(f"<div{name}>" + rng.choice(["", " | ", " "]).join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(k)) + "</div>", False)
            elif kind == 2:
                k = rng.randint(2, 6)
                add(f"<div{name}>" + "".join(f'<div><a href="/{word()}">{words(1, 6)}</a></div>' for _ in range(k)) + "</div>", *[False] * k)
            elif kind == 3:
                add(f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>", False, False)
            else:
                k = rng.randint(2, 6)
                add(f"<table{name}><tr>" + "".join(f'<td><a href="/{word()}">{words(1, 2)}</a></td>' for _ in range(k)) + "</tr></table>", *[False] * k)

        def other(add=add, links=links) -> None:
            if bare:
                return plain()
            kind = rng.randrange(11)
            if kind == 0:
                add(f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "sponsored"])}">{prose(3, 40)}</div>', False)
            elif kind == 1:
                add(f'<div id="{rng.choice(["cookie-notice", "consent", "notice"])}"><p>{prose(5, 30)}</p><button>{words(1, 2)}</button></div>', False, False)
            elif kind == 2:
                add(f"<aside><h3>{words(1, 3)}</h3><p>{prose(4, 60)}</p></aside>", False, False)
            elif kind == 3:
                links('<div class="sidebar">', "</div>", 2, 6)
            elif kind == 4:
                add(f'<form class="newsletter"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>', False, False)
            elif kind == 5:
                links(f'<div class="{rng.choice(["related", "breadcrumb", "social share", "pagination"])}">', "</div>", 2, 5)
            elif kind == 6:
                add(f'<p class="{rng.choice(["ad", "promo", "notice", "disclaimer"])}">{prose(4, 30)}</p>', False)
            elif kind == 7:
                k = rng.randint(1, 4)
                who = rng.choice(['<div class="comments">', '<section id="comments">', '<div class="comment-list">'])
                shut = "</section>" if "section" in who else "</div>"
                add(who + "".join(f'<div class="comment"><b>{word()}</b> {prose(4, 60)}</div>' for _ in range(k)) + shut, *[False] * k)
            elif kind == 10:
                add(f'<div class="{rng.choice(["promo-box", "ad-slot", "sponsor box", "banner-inner"])}"><p>{prose(2, 25)}</p></div>', False)
            elif kind == 8:
                add(f'<aside class="notice">{prose(4, 30)}</aside>', False)
            else:
                add(f"<form><p>{prose(3, 12)}</p><input></form>", False)

        if bare:
            plain()
        elif rng.random() < 0.8:
            tag = rng.choice(["nav", "nav", "header", 'div class="menu"', 'div id="navigation"'])
            links(f"<{tag}>", f"</{tag.split()[0]}>", 2, 8)
        if not bare and rng.random() < 0.3:
            add(f"<header><h2>{words(1, 4)}</h2><p>{prose(2, 12)}</p></header>", False, False)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            other()
        holder = rng.choice(["body-only", "div", "div", f'div class="{word()}"', 'div id="c1"', "td", "center"]) if bare else rng.choice(["article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', "section", 'div class="entry"', "body-only"])
        add("" if holder == "body-only" else "<table><tr><td>" if holder == "td" else f"<{holder}>")
        if rng.random() < 0.7:
            add(f"<h1>{words(2, 10)}</h1>", True)
        loose = bare and rng.random() < 0.25  # text without paragraphs
        if loose:
            add("<div>" + "<br><br>".join(prose(8, 80) for _ in range(rng.randint(1, 4))) + "</div>", True)
        for k in range(0 if loose else rng.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.7:
                n = rng.choice([1, 3, 5, 8, 12, 20, 60, 120])
                body = prose(max(1, n // 2), n + 2)
                if rng.random() < 0.2:
                    body = f'{body} <a href="/{word()}">{words(1, 4)}</a> {prose(1, 20)}'
                if rng.random() < 0.25:
                    add(f"<p><b>{body}<br>", True)
                else:
                    add(f"<p>{body}</p>", True)
            elif kind < 0.78:
                add(f"<h2>{words(1, 6)}</h2>", True)
            elif kind < 0.84:
                n = rng.randint(1, 4)
                add("<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
            elif kind < 0.88:
                add(f"<blockquote>{prose(3, 40)}</blockquote>", True)
            elif kind < 0.9:
                n = rng.randint(1, 3)
                add("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 8)}</td></tr>" for _ in range(n)) + "</table>", *[True] * 2 * n)
            elif kind < 0.92:
                add(f"<pre>{words(3, 30)}</pre>", True)
            elif kind < 0.94:
                add(f"<div>{prose(10, 60)}<br>{prose(3, 20)}</div>", True)
            if k and rng.random() < 0.1:
                other()
        if rng.random() < 0.12:  # the page breaks off
            out.append(("".join(html), marks))
            continue
        if holder != "body-only" and rng.random() < 0.95:
            add("</td></tr></table>" if holder == "td" else f"</{holder.split()[0]}>")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            other()
        if bare and rng.random() < 0.8:
            add(rng.choice(["<div>{}</div>", "<p>{}</p>", '<div class="row">{}</div>']).format(f"&copy; {rng.randint(1998, 2025)} {words(1, 8)}"), False)
        elif not bare and rng.random() < 0.85:
            add(f'<{(tag := rng.choice(["footer", "footer", "div"]))}{" class=footer" if tag == "div" else ""}>&copy; {word()}.example &middot; {prose(2, 25)}</{tag}>', False)
        if rng.random() < 0.8:
            add("</body></html>")
        out.append(("".join(html), marks))
    return out


# -- the field -------------------------------------------------------------------------


class Field:
    """Weights of features for "main" against "other", and of transitions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros(0)
        self.move = np.zeros((2, 2))

    def scores(self, blocks: list[Block]) -> np.ndarray:
        get, w = self.index.get, self.weights
        return np.array([sum([w[i] for f in features(blocks, k) if (i := get(f)) is not None]) for k in range(len(blocks))])

    @property
    def weights(self) -> list[float]:
        if not hasattr(self, "_list"):
            self._list = self.w.tolist()
        return self._list

    def train(self, pages: list[tuple[str, list[bool]]], rounds: int = 160, rate: float = 0.3, decay: float = 2e-4) -> Field:
        rows = []
        for html, marks in pages:
            blocks = blocks_of(html)
            if len(blocks) != len(marks):
                raise ValueError(f"{len(blocks)} blocks and {len(marks)} labels in {html[:200]}")
            rows.append(([[self.index.setdefault(f, len(self.index)) for f in features(blocks, k)] for k in range(len(blocks))], np.array(marks, int)))
        most = max(len(m) for _, m in rows)
        # all pages side by side, padded to the longest
        count, size = len(rows), len(self.index)
        x = np.zeros((count, most, size), np.float32)
        y = np.zeros((count, most), int)
        real = np.zeros((count, most), bool)
        for i, (fs, m) in enumerate(rows):
            for k, f in enumerate(fs):
                x[i, k, f] = 1
            y[i, : len(m)], real[i, : len(m)] = m, True
        self.w = np.zeros(size)
        square = [np.full(size, 1e-8), np.full((2, 2), 1e-8)]
        both = real[:, 1:]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
        for _ in range(rounds):
            unary = np.stack([np.zeros((count, most)), x @ self.w.astype(np.float32)], axis=2)
            alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
            alpha[:, 0] = unary[:, 0]
            for k in range(1, most):
                a = np.logaddexp(alpha[:, k - 1, 0, None] + self.move[0], alpha[:, k - 1, 1, None] + self.move[1]) + unary[:, k]
                alpha[:, k] = np.where(real[:, k, None], a, alpha[:, k - 1])
            for k in range(most - 2, -1, -1):
                t = unary[:, k + 1] + beta[:, k + 1]
                b = np.logaddexp(self.move[:, 0] + t[:, 0, None], self.move[:, 1] + t[:, 1, None])
                beta[:, k] = np.where(real[:, k + 1, None], b, 0)
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None])
            grad = np.einsum("ik,ikf->f", np.where(real, y - p, 0), x) / count - decay * self.w
            pair = alpha[:, :-1, :, None] + self.move + unary[:, 1:, None, :] + beta[:, 1:, None, :] - total[:, None, None, None]
            expected = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum(axis=(0, 1))
            step = (seen - expected) / count - decay * self.move
            square[0] += grad**2
            square[1] += step**2
            self.w += rate * grad / np.sqrt(square[0])
            self.move += rate * step / np.sqrt(square[1])
        return self

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi; of equals "other"."""
        if not blocks:
            return []
        (oo, om), (mo, mm) = self.move.tolist()
        scores = self.scores(blocks).tolist()
        o, m, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_o = (o + oo >= m + mo, o + om >= m + mm)
            back.append(from_o)
            o, m = (o + oo if from_o[0] else m + mo), s + (o + om if from_o[1] else m + mm)
        label = m > o
        out = [label]
        for b in reversed(back):
            label = not b[label]
            out.append(label)
        return out[::-1]


def main_text(field: Field, html: str | None) -> str:
    blocks = blocks_of(html)
    return " ".join([b.text for b, keep in zip(blocks, field.decode(blocks), strict=True) if keep])


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return Field().train(labelled_pages())


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    spark = pages.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(field or trained_field())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*columns_of(batch, "page_id", "url", "html"), strict=True):
                text = main_text(sent.value, html)
                rows.append((page_id, url, text, len(text)))
            yield to_batch(schema, rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )

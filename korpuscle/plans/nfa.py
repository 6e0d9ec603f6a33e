"""Position automaton of a pattern, run as a lazily built deterministic one over clause bit masks."""

from __future__ import annotations

from .cql import Alt, Clause, Repeat, Seq


class Automaton:
    """States are sets of places in the pattern, as bits; a token is the mask of clauses that it meets."""

    def __init__(self, pattern):
        self.clauses: list[Clause] = []
        self.place_clause: list[int] = []  # the clause of each place
        self.follow: list[int] = []
        first, last, self.empty = self._build(pattern)
        self.first, self.last = first, last
        self.memo: dict[tuple[int, int], int] = {}

    def _build(self, q) -> tuple[int, int, bool]:
        """First places, last places, and whether nothing matches too."""
        if isinstance(q, Clause):
            if q not in self.clauses:
                self.clauses.append(q)
            bit = 1 << len(self.place_clause)
            self.place_clause.append(self.clauses.index(q))
            self.follow.append(0)
            return bit, bit, False
        if isinstance(q, Alt):
            parts = [self._build(o) for o in q.options]
            return _or(p[0] for p in parts), _or(p[1] for p in parts), any(p[2] for p in parts)
        if isinstance(q, Seq):
            return self._chain([lambda p=p: self._build(p) for p in q.parts])
        if isinstance(q, Repeat):
            need = [lambda: self._build(q.of)] * q.low
            if q.high is None:
                more = [lambda: self._loop(q.of)]
            else:
                more = [lambda: self._maybe(q.of)] * (q.high - q.low)
            return self._chain(need + more) if need or more else (0, 0, True)
        raise TypeError(f"no pattern: {q!r}")

    def _maybe(self, q):
        f, e, _ = self._build(q)
        return f, e, True

    def _loop(self, q):
        f, e, _ = self._build(q)
        self._tie(e, f)
        return f, e, True

    def _tie(self, ends: int, starts: int) -> None:
        k = 0
        while ends >> k:
            if ends >> k & 1:
                self.follow[k] |= starts
            k += 1

    def _chain(self, builders):
        first, last, empty = 0, 0, True
        for build in builders:
            f, e, skip = build()
            self._tie(last, f)
            first |= f if empty else 0
            last = e | (last if skip else 0)
            empty &= skip
        return first, last, empty

    def _enter(self, places: int, mask: int) -> int:
        key = (places, mask)
        out = self.memo.get(key)
        if out is None:
            out = 0
            for k, clause in enumerate(self.place_clause):
                if places >> k & 1 and mask >> clause & 1:
                    out |= 1 << k
            self.memo[key] = out
        return out

    def _next(self, state: int) -> int:
        key = (state, -1)
        out = self.memo.get(key)
        if out is None:
            out = _or(f for k, f in enumerate(self.follow) if state >> k & 1)
            self.memo[key] = out
        return out

    def matches(self, masks: list[int], overlapping: bool = False) -> list[tuple[int, int]]:
        """Leftmost-longest spans of at least one token, each starting at or after the last one's end."""
        out, at, n = [], 0, len(masks)
        while at < n:
            state, end, i = self._enter(self.first, masks[at]), 0, at
            while state:
                i += 1
                if state & self.last:
                    end = i
                if i >= n:
                    break
                state = self._enter(self._next(state), masks[i])
            if end:
                out.append((at, end))
            at = end if end and not overlapping else at + 1
        return out


def _or(xs) -> int:
    out = 0
    for x in xs:
        out |= x
    return out

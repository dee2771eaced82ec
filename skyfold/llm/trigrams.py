"""Trigram index for regular expressions: Boolean queries from patterns, postings per segment, exact verification.

``required`` derives from a pattern a query in disjunctive form: a match must hold all trigrams of at least one of the
sets. A pattern without such trigrams gives the set that holds nothing, which is true of every text (a full scan).
``Segment`` is the inverted index of a block of texts: sorted (trigram, text) pairs, looked up by bisection.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np

#: Exact alternatives that are followed through a concatenation, and sets a query may hold.
MOST_STRINGS = 64

Query = frozenset  # of frozensets of trigrams; {{}} holds for every text
ANY: Query = frozenset([frozenset()])


def _absorb(sets) -> Query:
    """Drops sets that a smaller one implies; too many alternatives say nothing."""
    kept: list[frozenset] = []
    for s in sorted(set(sets), key=len):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept) if len(kept) <= MOST_STRINGS else ANY


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS * 4:
        return min(a, b, key=len)
    return _absorb(x | y for x in a for y in b)


def _of_string(s: str) -> frozenset:
    raw = s.lower().encode()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


def _of_strings(strings) -> Query:
    return _absorb(_of_string(s) for s in strings)


def _sequence(items, ignore_case: bool) -> tuple[set[str] | None, Query]:
    """The strings a parsed sequence can be, if few, and what every match must hold."""
    run, query, exact = {""}, ANY, True
    for op, arg in items:
        strings, need = _item(str(op), arg, ignore_case)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query = _both(_both(query, _of_strings(run)), need if strings is None else _of_strings(strings))
        run, exact = {""}, False
    if exact:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def _item(op: str, arg, ignore_case: bool) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg)}, ANY
    if op == "IN":
        chars = [chr(a) for o, a in arg if str(o) == "LITERAL"]
        return (set(chars), ANY) if len(chars) == len(arg) <= 4 else (None, ANY)
    if op == "SUBPATTERN":
        return _sequence(arg[-1], ignore_case)
    if op == "BRANCH":
        found = [_sequence(x, ignore_case) for x in arg[1]]
        strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
        return strings, _absorb(t for _, q in found for t in q)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = int(arg[0]), int(arg[1]), arg[2]
        strings, need = _sequence(body, ignore_case)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=least)}, ANY
        return None, need if least else ANY
    if op == "AT":
        return {""}, ANY
    return None, ANY


def required(pattern: str, flags: int = 0) -> Query:
    """What any match must hold, as trigrams of the lower-cased text; upper and lower case share one index."""
    return _sequence(re._parser.parse(pattern, flags), bool(flags & re.I))[1]


_PIECE = 1 << 20


def _codes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


def _unique(a: np.ndarray) -> np.ndarray:
    a.sort()
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


class Segment:
    """Postings of a block of texts (bytes, A-Z already lower-cased): each trigram's texts, ascending."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        block, ends = bytearray(), []
        found: list[np.ndarray] = []

        def flush():
            if block:
                size = np.diff(np.array([0, *[e for e, _ in ends]]))
                owner = np.repeat(np.array([i for _, i in ends], np.int64), size)
                # A trigram over the end of its piece belongs to no text.
                whole = np.ones(len(block), bool)
                last = np.array([e for e, _ in ends])
                whole[np.maximum(last - 1, 0)] = False
                whole[np.maximum(last - 2, 0)] = False
                codes = _codes(bytes(block))
                found.append(_unique((codes << 32 | owner[:-2])[whole[:-2]]))
                block.clear()
                ends.clear()

        for i, text in enumerate(texts):
            for lo in range(0, max(len(text) - 2, 0), _PIECE):
                block.extend(text[lo : lo + _PIECE + 2])
                ends.append((len(block), i))
                if len(block) >= _PIECE:
                    flush()
        flush()
        self.pairs = _unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def postings(self, trigram: bytes) -> np.ndarray:
        code = int.from_bytes(trigram, "big")
        lo, hi = np.searchsorted(self.pairs, (code << 32, (code + 1) << 32))
        return self.pairs[lo:hi] & 0xFFFFFFFF

    def candidates(self, query: Query) -> np.ndarray:
        """Texts for which the query holds."""
        out = np.empty(0, np.int64)
        for needed in query:
            if not needed:
                return np.arange(self.n)
            lists = sorted((self.postings(t) for t in needed), key=len)
            got = lists[0]
            for other in lists[1:]:
                if not len(got):
                    break
                got = np.intersect1d(got, other, assume_unique=True)
            out = np.union1d(out, got)
        return out

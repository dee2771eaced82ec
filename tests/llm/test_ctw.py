from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from tests.llm.conftest import odd_rows

from skyfold.llm import ctw, segments
from skyfold.llm.common import documents


def log_kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)


class Brute:
    """Context trees as dictionaries; a bit's probability is the ratio of the root's weighted probabilities with and without it."""

    def __init__(self, bodies, depth):
        self.depth, self.counts, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for body in bodies:
            padded = ctw.END * depth + body
            for i in range(depth, len(padded)):
                for k in range(8):
                    node, bit = (1 << k) | (padded[i] >> (8 - k)), (padded[i] >> (7 - k)) & 1
                    for d in range(depth + 1):
                        context = padded[i - d : i]
                        self.counts[context, node][bit] += 1
                        if d:
                            self.below[context[1:], node].add(context)

    def weighted(self, context, node, path=None, bit=None):
        n = list(self.counts.get((context, node), (0, 0)))
        if path is not None and (not context or path.endswith(context)):
            n[bit] += 1
            extended = True
        else:
            extended = False
        own = log_kt(*n)
        if len(context) == self.depth:
            return own
        children = set(self.below.get((context, node), ()))
        if extended:
            children.add(path[-len(context) - 1 :])
        deep = sum(self.weighted(c, node, path if extended and path.endswith(c) else None, bit) for c in children)
        return max(own, deep) + math.log1p(math.exp(-abs(own - deep))) - math.log(2)

    def bits(self, body):
        padded, total = ctw.END * self.depth + body, 0.0
        for i in range(self.depth, len(padded)):
            for k in range(8):
                node, bit = (1 << k) | (padded[i] >> (8 - k)), (padded[i] >> (7 - k)) & 1
                total -= self.weighted(b"", node, padded[i - self.depth : i], bit) - self.weighted(b"", node)
        return total / math.log(2)


def held(i):
    import zlib

    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def bodies(rows):
    return {k: ctw.body_of(ctw.words_of((t or "").encode())) for k, (_, t) in enumerate(rows)}


def test_code_lengths_are_those_of_context_trees(spark):
    rows = [(i, t) for i, t in enumerate(["abra cadabra", "Abra", "", None, "barbara abra", "xyz", "abra cadabra", "ab ra", "cab", "ra", "zz"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(df).collect()}
    text = bodies(rows)
    model = Brute([text[i] for i, _ in rows if not held(i)], ctw.DEPTH)
    for i, _ in rows:
        assert got[i].held_out == held(i) and got[i].n_bytes == len(text[i])
        assert got[i].score == pytest.approx(-model.bits(text[i]) * math.log10(2), abs=1e-6)


def check_base(rows, got):
    split = [ctw.words_of((t or "").encode()) + [b""] for _, t in rows]
    train = Counter(w for (i, _), ws in zip(rows, split, strict=True) if not held(i) for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted(
        (i is None, i or 0, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 5))
        for (i, _), ws in zip(rows, split, strict=True)
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_base_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT_BYTES", 50_000)  # several segments and buckets
    got = ctw.score(odd).collect()
    check_base([(r[0], r[1]) for r in odd_rows()], got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert ctw.score(none).count() == 0


def test_segments_do_not_change_results(spark, monkeypatch):
    docs = documents(spark, "/root/testdata/sf0.001")
    one = {r.doc_id: r for r in ctw.score(docs).collect()}
    monkeypatch.setattr(segments, "SEGMENT_BYTES", 60_000)
    many = {r.doc_id: r for r in ctw.score(docs).collect()}
    assert one.keys() == many.keys()
    assert all(one[i].score == pytest.approx(many[i].score, rel=1e-9) for i in one)
    check_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], one.values())

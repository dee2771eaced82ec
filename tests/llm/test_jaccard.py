from __future__ import annotations

import random

import pytest
from tests.llm.conftest import odd_rows

from skyfold.llm import jaccard, segments
from skyfold.llm.components import components


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, words=4, percent=85):
    """Per row (id, shingles, smallest id of its group), by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None)))
    return sorted(out, key=repr)


def corpus(seed, n=140):
    """Groups of near copies of every degree, chains, and passages that many documents share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randint(6, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        if rng.random() < 0.3:
            text = [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            text += shared
        rows.append((i * 3 + 5, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(segments, "SEGMENT_BYTES", 8000)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5 if seed == 1 else 512)  # large cells in blocks, or whole
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.jaccard_groups(df).collect()), key=repr) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert sorted((tuple(r) for r in jaccard.jaccard_groups(odd).collect()), key=repr) == brute(rows)
    assert jaccard.jaccard_groups(none).count() == 0
    kept = jaccard.one_per_group(odd)
    assert kept.columns == odd.columns
    groups = {(c, n) for _, n, c in brute(rows, 5, 80) if n}
    assert kept.count() == len(groups) + sum(n == 0 for _, n, _ in brute(rows, 5, 80))
    assert jaccard.one_per_group(none).count() == 0


def test_blocks_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        change = rng.integers(0, 60, rng.integers(0, 9))
        s[change] = rng.integers(1, 1 << 60, len(change)).astype(np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    numbers = np.arange(len(sets))
    pairs = jaccard.block_links(sets, sizes, numbers, numbers, 85)
    near = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    assert all(near(a, b) for a, b in pairs)

    def closed(links):
        root = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert closed(pairs) == closed([(a, b) for a in numbers for b in numbers if near(a, b)])


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 240)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            for x in group:
                want[x] = group
    assert got.keys() == want.keys()
    assert all((got[a] == got[b]) == (b in want[a]) for a in want for b in want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

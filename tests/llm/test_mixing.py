from __future__ import annotations

import random
from collections import Counter

import pytest
from tests.compare import difference
from tests.llm.conftest import odd_rows

from skyfold.llm import mixing
from skyfold.llm.common import documents


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def test_against_sql_and_resharing(spark, odd, duck_docs):
    for df in (odd, documents(spark, "/root/testdata/sf0.001")):
        con, sql = duck_docs(df, mixing.MIX_SQL)
        assert difference(mixing.mix_report(df), con, sql) is None
    rows = mixing.mix_report(documents(spark, "/root/testdata/sf0.01")).collect()
    want = fill(dict(Counter({s: sum(r.size for r in rows if r.source == s) for s in {r.source for r in rows}})))
    for s, t in want.items():
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in own) - t) <= max(r.size for r in own)
    assert all(r.taken <= 3 * r.size for r in rows)


def test_one_size_fills_buckets(spark):
    """A source of equal sizes is dealt over its buckets, and the copies still follow one prefix sum."""
    df = spark.createDataFrame([(i, "a b", "x") for i in range(5000)] + [(i, "a b", "y") for i in range(50_000, 51_000)], "doc_id long, text string, source string")
    got = mixing.mix_report(df).groupBy("source").sum("taken", "size").collect()
    aims = fill({"x": 10_000, "y": 2000})
    assert all(abs(r["sum(taken)"] - aims[r.source]) <= 2 for r in got)


def test_mixed_rows_and_odd_rows(spark, odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    words = Counter()
    for r in mixing.mix_report(odd).collect():
        words[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert +got == +words
    assert mixing.mix_report(odd).count() == len(odd_rows())
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_is_the_same_in_any_row_order(spark):
    rows = [(7, f"word{i} and two", "a" if i % 5 else "b") for i in range(40)]
    mixes = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(seed + 1)
        mixes.append(sorted(r.text for r in mixing.mix(df).collect()))
    assert mixes[0] == mixes[1] == mixes[2] and len(set(mixes[0])) < 40

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from tests.compare import difference

from skyfold.llm import divergence
from skyfold.llm.common import documents


def test_against_sql(spark, odd, duck_docs):
    small = documents(spark, "/root/testdata/sf0.001")
    words = "Alpha beta GAMMA delta épée ñu zeta".split()
    rnd = random.Random(5)
    rows = [(None, " ".join(rnd.choices(words, k=rnd.randint(0, 9))), rnd.choice(["en", "de", None]), rnd.choice(["x", "y", None, "z"])) for _ in range(200)]
    rows += [(1, "only-here 12", "fr", "x"), (1, None, "fr", "y")]
    for df in (odd.filter("text NOT LIKE 'nul%' OR text IS NULL"), small, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")):
        con, sql = duck_docs(df, divergence.AUDIT_SQL)
        assert difference(divergence.audit(df), con, sql) is None


def test_blocks_and_flushes_change_nothing(spark, duck_docs, monkeypatch):
    """Tiny blocks and folds give the sums of whole columns."""
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", 200)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    df = documents(spark, "/root/testdata/sf0.001")
    con, sql = duck_docs(df, divergence.AUDIT_SQL)
    assert difference(divergence.audit(df), con, sql) is None


def test_run_columns_and_sums():
    rnd = random.Random(11)
    for _ in range(50):
        rows = rnd.randint(1, 40)
        lists = [[{"source": s, "n": rnd.randint(1, 3)} for s in "abc" if rnd.random() < 0.5] for _ in range(rows)]
        length = np.array([rnd.randint(1, 5) for _ in range(rows)])
        columns = divergence.run_columns(pa.array(lists, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))), ["a", "b", "c"])
        dense = [[next((c["n"] for c in row if c["source"] == s), 0) for row in lists] for s in "abc"]
        for (starts, values), want in zip(columns, dense, strict=True):
            assert np.repeat(values, np.diff(np.append(starts, rows))).tolist() == want
            assert all(a != b for a, b in zip(values, values[1:], strict=False))
        shares = [(starts, divergence.shares(n, 90, 40)) for starts, n in columns]
        p, q = ([1 + 10**9 * (n + 2) // 170 for n in d] for d in dense[:2])
        want = sum((a - b) ** 2 // (a + b) * int(k) for a, b, k in zip(p, q, length, strict=True))
        assert divergence.run_sum(shares[0], shares[1], np.concatenate([[0], np.cumsum(length)])) == want


def test_shares_of_huge_counts_are_exact():
    counts = [0, 5, 9_300_000_000, 4 * 10**15]
    got = divergence.shares(np.array(counts), 10**16, 10**6)
    assert got.tolist() == [1 + int(Fraction(10**9 * (c + 2), 10**16 + 2 * 10**6)) for c in counts]


def test_no_terms_and_no_rows(spark, none):
    df = spark.createDataFrame([(1, "a", "en", "x"), (2, None, "en", "y"), (3, "..", "en", None)], "doc_id long, text string, lang string, source string")
    rows = divergence.audit(df).collect()
    assert sorted((r.source, r.item, r.value, r.part) for r in rows) == [(a, b, 0, "pair") for a in ("", "x", "y") for b in ("", "x", "y") if a != b]
    assert all(r["rank"] == 1 + ["", "x", "y"].index(r.item) - (r.item > r.source) for r in rows)
    assert divergence.audit(none).count() == 0

from __future__ import annotations

from tests.compare import difference
from tests.llm.conftest import odd_rows

from skyfold.llm import quality
from skyfold.llm.common import documents


def test_counts_against_brute_force(spark, odd, none):
    got = sorted((tuple(r) for r in quality.features(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr)
    want = []
    for i, text, *_ in odd_rows():
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 1000 else set(windows)
        covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want, key=repr)
    assert quality.judge(none).count() == 0


def test_against_sql(spark, odd, duck_docs):
    for df in (odd.filter("doc_id <> 13 OR doc_id IS NULL"), documents(spark, "/root/testdata/sf0.001")):
        con, sql = duck_docs(df, quality.JUDGE_SQL)
        assert difference(quality.judge(df), con, sql) is None


def test_labels_are_met(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(documents(spark, sf)).join(documents(spark, sf, "labels"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.n_words >= 20]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_native_plan(spark, odd):
    plan = quality.judge(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

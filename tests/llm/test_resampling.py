from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from tests.compare import difference
from tests.llm.conftest import odd_rows

from skyfold.llm import resampling
from skyfold.llm.common import documents


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, least, most):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, least=1, most=1, buckets=resampling.BUCKETS):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [Counter(map(bucket, grams(t, least, most))) for _, t in docs]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, grams(x, least, most))) for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for (i, text), c in zip(docs, own, strict=True):
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        rows.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(able[: 10 * len(able) // 100], 1)}
    return sorted([(*r[:4], place.get(id(r))) for r in rows], key=repr)


def got_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 2)])
def test_spans_are_all_ngrams(least, most):
    patterns = resampling.gram_patterns(least, most)
    for _, text, *_ in odd_rows():
        line = resampling.collapsed((text or "").encode())
        assert [line[a:b].decode() for a, b in resampling.feature_spans(line, patterns)] == grams(text, least, most)


def test_against_brute_force_and_sql(spark, duck_docs):
    sf = "/root/testdata/sf0.01"
    docs, target = documents(spark, sf), documents(spark, sf, "benchmark")
    rows = got_of(resampling.report(docs, target))
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    con, sql = duck_docs(docs.select("doc_id", "text").filter("doc_id < 300"), resampling.RESAMPLE_SQL)
    con.register("b", target.toArrow())
    con.execute("CREATE TABLE benchmark AS SELECT * FROM b")
    assert difference(resampling.report(docs.filter("doc_id < 300"), target), con, sql) is None


def test_longer_grams_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_LEAST", 20)
    sf = "/root/testdata/sf0.001"
    docs, target = documents(spark, sf), documents(spark, sf, "benchmark")
    found = resampling.importance(docs, target, 1, 2, 512)
    assert got_of(found) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 1, 2, 512)


def test_ties_of_one_id_get_every_rank_once(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "one two three " * 10) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("one",)], "text string")
    ranks = [r["rank"] for r in resampling.report(docs, target).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, 41))


def test_odd_rows_and_empty_tables(spark, odd, none):
    for target in (none.select("text"), odd.select("text")):
        rows = resampling.report(odd, target)
        assert got_of(rows)[0][1] >= 0 and rows.count() == len(odd_rows())
        assert resampling.report(none, target).count() == 0
    drawn = resampling.resample(odd, odd.select("text"))
    assert drawn.columns == odd.columns


def test_drawn_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, target = documents(spark, sf), documents(spark, sf, "benchmark")
    ids = {r.doc_id for r in resampling.report(docs, target).collect() if r["rank"]}
    assert {r.doc_id for r in resampling.resample(docs, target).collect()} == ids

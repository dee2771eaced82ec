from __future__ import annotations

import zlib
from collections import defaultdict

from tests.llm.conftest import PROSE, odd_rows

from skyfold.llm import shards
from skyfold.llm.common import documents


def check(rows, texts, n=16):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    raw = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts]
    assert sorted(map(key, ((r.doc_id, r.size, r.text_crc32) for r in rows))) == sorted(map(key, raw))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sizes_are_nearly_equal_and_equal_texts_together(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    rows = shards.shard_documents(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    sizes, where = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        where[r.text_crc32, r.size].add(r.shard)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    assert sum(len(x) > 1 for x in where.values()) == 0


def test_a_hot_text_is_spread(spark):
    df = spark.createDataFrame([(i, PROSE if i % 2 else f"{i} {PROSE}") for i in range(6000)], "doc_id long, text string")
    rows = shards.shard_documents(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 16
    assert all(abs(s - mean) < 0.1 * mean for s in sizes.values())


def test_groups_beside_a_hot_text_stay_together(spark):
    df = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else f"text {i // 15} {i % 3}") for i in range(60_000)], "doc_id long, text string")
    rows = shards.shard_documents(df).collect()
    check(rows, [(r.doc_id, r.text) for r in df.collect()])
    sizes, where = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        where[r.text_crc32, r.size].add(r.shard)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(s - mean) < 0.1 * mean for s in sizes.values())
    assert [k for k, x in where.items() if len(x) > 1] == [(zlib.crc32(b"hot text"), 9)]


def test_odd_rows(spark, odd, none):
    check(shards.shard_documents(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert shards.shard_documents(none).count() == 0
    plan = shards.shard_documents(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

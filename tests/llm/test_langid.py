from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import odd_rows

from skyfold.llm import langid
from skyfold.llm.common import documents


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 3])
    starts = np.cumsum(lengths) - lengths
    emit, moves, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    pairs = np.zeros((3, 3))
    got = langid.forward_backward(emit, starts, lengths, moves, start, pairs)
    want, want_pairs = np.zeros_like(emit), np.zeros((3, 3))
    for s, n in zip(starts, lengths, strict=True):
        weights = {}
        for path in product(range(3), repeat=int(n)):
            score = start[path[0]] + sum(emit[s + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
            weights[path] = np.exp(score)
        z = sum(weights.values())
        for path, w in weights.items():
            for t, k in enumerate(path):
                want[s + t, k] += w / z
            for a, b in zip(path, path[1:], strict=False):
                want_pairs[a, b] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy_and_code_switching(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = langid.train(docs)
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([lang[r.doc_id][0] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    # A text of two languages: words are labelled piece by piece.
    de = next(t for k, t in lang.values() if k == "de" and len(t) > 800)
    es = next(t for k, t in lang.values() if k == "es" and len(t) > 800)
    words = (" ".join(de.split()[:40]) + " " + " ".join(es.split()[:40])).lower().split()
    scores = langid._scores(words, model)
    best = langid.forward_backward(scores, np.array([0]), np.array([len(words)]), model.moves, model.start).argmax(1)
    named = [model.labels[k] for k in best]
    assert np.mean([x == "de" for x in named[:40]]) > 0.9 and np.mean([x == "es" for x in named[40:]]) > 0.9


def test_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2, 3, 10))
    assert by_id[4].lang_pred == "en"
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.in_known_language(odd)
    assert kept.columns == odd.columns and kept.filter("text IS NULL OR text = ''").count() == 0


def test_texts_in_three_languages_stay(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    long = [r for r in docs.filter("length(text) > 800 AND lang IS NOT NULL").orderBy("doc_id").collect()]
    parts = [next(r.text for r in long if r.lang == k).split()[:40] for k in ("de", "en", "es")]
    mixed = [(10**9, " ".join(w for p in parts for w in p), None), (10**9 + 1, "12 34 ...", None)]
    df = docs.union(spark.createDataFrame(mixed, docs.schema))
    score = {r.doc_id: r.score for r in langid.label(df, langid.train(df)).filter("doc_id >= 1000000000").collect()}
    assert score[10**9] < 0.5
    assert [r.doc_id for r in langid.in_known_language(df).filter("doc_id >= 1000000000").collect()] == [10**9]
    plain = spark.createDataFrame([*mixed, (1, None, None), (2, "", None)], docs.schema)
    assert [r.doc_id for r in langid.in_known_language(plain).collect()] == [10**9]


def test_strangers_go_and_clean_texts_stay(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = [(10**9 + i, " ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(40)), None) for i in range(50)]
    rows = docs.collect()
    left = docs.filter("lang <> 'es'").union(spark.createDataFrame([*junk, *[(r.doc_id, r.text, None) for r in rows if r.lang == "es"]], docs.schema))
    kept = {r.doc_id for r in langid.in_known_language(left).collect()}
    strange, own = {r.doc_id for r in rows if r.lang == "es"}, {r.doc_id for r in rows if r.lang not in (None, "es")}
    assert not kept & {i for i, _, _ in junk}
    assert len(strange) > 50 and len(kept & strange) <= 0.1 * len(strange) and len(kept & own) >= 0.99 * len(own)

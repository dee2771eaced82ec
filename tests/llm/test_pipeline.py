from __future__ import annotations

from tests.llm.conftest import odd_rows
from tests.llm.test_decontaminate import norm
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import fill

import corpus_pipeline
from skyfold.llm import langid
from skyfold.llm.common import documents
from skyfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    (_, language), (_, near), (_, leaks), (_, mix), (_, files) = corpus_pipeline.STAGES
    one = language(spark, docs, SF)
    model = langid.train(docs, strangers=True)
    known = {r.doc_id for r in langid.label(docs, model).collect() if r.lang_pred != "und" and r.certainty >= model.least}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == known
    two = near(spark, one, SF).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, _, c in brute(rows, 5, 80) if i == c}
    three = leaks(spark, two, SF).cache()
    bench = [norm(r.text) for r in documents(spark, SF, "benchmark").collect()]
    windows = {tuple(t[i : i + 12]) for t in bench for i in range(len(t) - 11)}
    held = {r.doc_id for r in two.collect() for t in [norm(r.text)] if any(tuple(t[i : i + 12]) in windows for i in range(len(t) - 11))}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - held
    four = mix(spark, three, SF).cache()
    words, took = {}, {}
    for table, out in ((three, words), (four, took)):
        for r in table.collect():
            out[r.source] = out.get(r.source, 0) + len(r.text.encode().split())
    longest = max(len(r.text.split()) for r in three.collect())
    assert all(abs(took.get(s, 0) - t) <= longest for s, t in fill(words).items())
    five = files(spark, four, SF)
    assert five.count() == four.count() and four.columns == docs.columns


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() <= 3 * len(odd_rows())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))

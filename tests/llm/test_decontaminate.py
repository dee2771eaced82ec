from __future__ import annotations

import random

from tests.llm.conftest import odd_rows

from skyfold.llm import decontaminate
from skyfold.llm.common import documents


def norm(text):
    strip = [w.lower().strip(".,;:!?—'\"<>|()") for w in (text or "").split()]
    return [w for w in strip if w]


def test_substitutions_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    word = lambda: f"t{rng.randint(0, 3000)}"
    items = [(k, [word() for _ in range(rng.randint(14, 60))]) for k in range(30)] + [(90, ["only", "four", "Rare", "words"])]
    docs, dirty = [], set()
    for i in range(200):
        text = [word() for _ in range(rng.randint(5, 300))]
        if i % 4 == 0:
            k, item = items[rng.randrange(30)]
            passage = list(item)
            for j in range(4, len(passage) - 1, 8):  # every eighth token is another
                passage[j] = word()
            at = rng.randrange(len(text))
            text[at:at] = passage
            dirty.add((i, k))
        docs.append((i, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in text)))
    docs += [(900, "x only four, rare words! y"), (901, "only four other rare words")]
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b).collect()}
    assert got.keys() == dirty | {(900, 90)}
    assert all(r.n_equal / r.n_tokens >= 0.8 for r in got.values())
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}


def test_against_exact_windows(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = documents(spark, sf), documents(spark, sf, "benchmark")
    windows = {tuple(t[i : i + 12]) for t in (norm(r.text) for r in bench.collect()) for i in range(len(t) - 11)}
    want = {r.doc_id for r in docs.collect() for t in [norm(r.text)] if any(tuple(t[i : i + 12]) in windows for i in range(len(t) - 11))}
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == want


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "the quick brown fox jumps over the lazy dog and runs far into the deep dark wood"), (2, "one")], "item_id long, text string")
    got = decontaminate.contaminated(odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 2), (7, 2), (8, 2), (None, 2)}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) - 6
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_best_stretch():
    import numpy as np

    eq = np.array([c == "=" for c in ".===.=====....==="])
    assert decontaminate.best_stretch(eq) == (5, 10, 5)
    assert decontaminate.best_stretch(np.array([c == "=" for c in "====.=======.="])) == (0, 12, 11)
    assert decontaminate.best_stretch(np.array([], bool)) == (0, 0, 0)


def test_longest_stretch_against_brute_force():
    import numpy as np

    rng = random.Random(5)
    for _ in range(500):
        eq = np.array([rng.random() < 0.75 for _ in range(rng.randint(0, 30))], bool)
        spans = [(b - a, -a) for a in range(len(eq)) for b in range(a + 1, len(eq) + 1) if 5 * eq[a:b].sum() >= 4 * (b - a)]
        n, first = max(spans, default=(0, 0))
        assert decontaminate.longest_stretch(eq) == (-first, n - first, eq[-first : n - first].sum())


def test_substitutions_at_random_places(spark):
    rng = random.Random(6)
    items, docs, want = [], [], set()
    for k in range(300):
        n = rng.randint(8, 22)
        item = [f"i{k}x{j}" for j in range(n)]
        gone = set(rng.sample(range(n), rng.randint(1, max(1, n // 5))))
        same = [j not in gone for j in range(n)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(["before", *[w if same[j] else f"s{j}" for j, w in enumerate(item)], "after"])))
        seed = any(all(same[at + o] for o in m) for m in decontaminate.MASKS for at in range(n - m[-1]))
        long = any(5 * sum(same[a:b]) >= 4 * (b - a) for a in range(n) for b in range(a + min(12, n), n + 1))
        if seed and long:
            want.add((k, k))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(5 * r.n_equal >= 4 * r.n_tokens for r in got)

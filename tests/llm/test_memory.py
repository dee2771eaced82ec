from __future__ import annotations

import sys
import tracemalloc

import numpy as np
import pytest

from skyfold.llm import decontaminate, jaccard, langid, segments


def asked_plainly(keys, buckets):
    distinct, counts = np.unique(keys, return_counts=True)
    bucket = (distinct >> np.uint64(8)).astype(np.int64) % buckets
    return {int(b): (distinct[bucket == b].tolist(), counts[bucket == b].tolist()) for b in np.unique(bucket)}


def test_a_segments_keys_are_not_held_many_times():
    rng = np.random.default_rng(3)
    n, buckets = 1_200_000, 16
    keys = rng.integers(0, 1 << 48, n, dtype=np.int64).astype(np.uint64)
    keys[::10] = keys[1::10]
    want = asked_plainly(keys, buckets)
    found = [segments.runs(part.copy()) for part in np.array_split(keys, 3)]
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    distinct, counts = segments.counted(found)
    got = segments.asked_rows(5, distinct, counts, jaccard._bucket(distinct, buckets))
    most = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    # Beside the keys that came in (16 bytes each): keys, counts, buckets and the order of both.
    assert most < 64 * n
    rows = zip(*(got.column(c).to_pylist() for c in ("bucket", "n", "keys", "counts")), strict=True)
    assert {b: (segments.unpack_keys(k, m).tolist(), segments.unpack_values(c, m, np.int64).tolist()) for b, m, k, c in rows} == want
    assert found == []  # the parts can go while their sum is packed


def held_mb():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_tasks_give_their_memory_back(none, monkeypatch):
    """A worker that waits for its next task holds little: freed memory between what is kept goes to the system."""
    seen, kept = [], []
    monkeypatch.setattr(type(none), "mapInArrow", lambda self, read, schema: seen.append(read) or none)
    segments.segmented(none, 1)
    langid.label(none, None)
    decontaminate._regions(none, np.zeros(8, np.uint8), list(decontaminate.MASKS), 1)

    def batches():
        parts = [np.ones(60_000, np.uint8) for _ in range(2500)]  # 150 MB while the task runs
        kept.extend(parts[::100])
        parts.clear()
        yield from ()

    assert len(seen) == 3
    for read in seen:
        before = held_mb()
        assert not list(read(batches()))
        assert held_mb() - before < 60


def test_words_are_scored_some_at_a_time(monkeypatch):
    pieces = [("aa", ["the", "house", "stands"]), ("bb", ["das", "haus", "steht"])] * 4
    model = langid.learn_strangers(langid.fit(pieces), pieces)
    words = [f"house{i}steht" for i in range(120_000)]
    tracemalloc.start()
    scores, shares = langid._scores(words, model), langid.familiarity(words, model.known)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 << 20
    monkeypatch.setattr(langid, "SCORED_WORDS", len(words))
    assert (scores == langid._scores(words, model)).all() and (shares == langid.familiarity(words, model.known)).all()
    assert langid._scores([], model).shape == langid.familiarity([], model.known).shape == (0, 2)

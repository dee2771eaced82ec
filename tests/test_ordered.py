from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.operators import ordered as O
from tests.conftest import rows


def brute_previous(data):
    """id -> value of the row before, per key by (t, id)."""
    out, last = {}, {}
    for k, t, i, v in sorted(data, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        out[i] = last.get(k) if k is not None else None
        if k is not None:
            last[k] = v
    return out


@pytest.mark.parametrize("most", [500_000, 1, 20, 80])
@pytest.mark.parametrize("seed", [1, 2])
def test_previous_event_with_hot_keys_and_ties(spark, most, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["warm"] * 3 + list("abc") + [None] * 3
    data = [(rng.choice(keys), rng.choice([None, 7, 7, 7, *range(40)]), i, i * 10) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int").repartition(5)
    got = {r["id"]: r["pv"] for r in O.previous_event(df, "k", "t", {"v": "pv"}, "id", most).collect()}
    assert got == brute_previous(data)


def test_one_moment_for_all_rows_is_still_split(spark):
    """Ties of any type cut a value that all rows share."""
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), F.format_string("id%05d", "id").alias("id"), F.col("id").alias("n"))
    sizes = [r["count"] for r in O.segmented(df, [F.col("t"), F.col("id")], 250).groupBy("_seg").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 600
    got = O.previous_event(df, "k", "t", {"n": "p"}, "id", 250).filter("p IS NULL OR p <> n - 1")
    assert [r["n"] for r in got.collect()] == [0]


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [(c,) for c in "cdefghijkl"] + [(None,)] * 50, "k string")
    assert rows(O.hot_keys(df, "k", 25)) == [("a",), ("b",)]


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_nulls_nan_and_string_ties(spark, descending):
    rng = random.Random(5)
    data = [(f"s{i:04d}", rng.choice([1.0, 2.0, 2.0, 2.0, 3.0, float("nan"), None, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(data, "id string, v double").repartition(5)
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    want = sorted(sorted(data), key=lambda r: key(r[1]), reverse=descending)
    if descending:  # a stable reverse keeps ties in the original order only when sorted twice
        want = sorted(sorted(data), key=lambda r: tuple(-x for x in key(r[1])))
    got = {r["id"]: r["row_num"] for r in O.global_rank(df, "v", "id", descending=descending, rows_per_segment=60).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(want)}


@pytest.mark.parametrize("descending", [False, True])
def test_global_rank(spark, descending):
    rng = random.Random(3)
    data = [(i, rng.choice([1.5, 2.0, 2.0, 9.0, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, v double").repartition(4)
    got = {r["id"]: r["row_num"] for r in O.global_rank(df, "v", "id", descending=descending, rows_per_segment=70).collect()}
    want = sorted(data, key=lambda r: ((-r[1] if descending else r[1]), r[0]))
    assert got == {i: n + 1 for n, (i, _) in enumerate(want)}


def test_totals_by_value_and_quantiles(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 5)]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = rows(O.totals_by_value(df, "v", {"n": F.lit(1)}, own=True), "v")
    assert [r[-2:] for r in got][-1][0] == 700 or got[-1][1] == 700
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(O.exact_quantiles(df, "v", probs), np.quantile(values, probs))
    assert O.exact_quantiles(df.filter("v IS NULL"), "v", probs) == []


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 6)], "k string, n int")
    got = rows(O.cumulative_share(df, "n", "k"), "k")
    assert [(r[0], round(r[2], 6), round(r[3], 6)) for r in got] == [("a", 10.0, 100.0), ("b", 30.0, 90.0), ("c", 60.0, 60.0)]


def test_top_n_per_group(spark):
    df = spark.createDataFrame([("a", i % 3, i) for i in range(9)] + [("b", 1, 0)], "g string, m int, id int")
    got = rows(O.top_n_per_group(df, "g", "m", 2, "id"))
    assert got == [("a", 2, 2, 1), ("a", 2, 5, 2), ("b", 1, 0, 1)]


@pytest.mark.parametrize("descending", [False, True])
def test_sketch_cuts_are_segments_of_the_order(spark, descending):
    """Every segment lies wholly before the next; nulls and NaN stand where the direction puts them; hot values fall back."""
    rnd = random.Random(4)
    data = [(i, rnd.choice([None, float("nan"), rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.uniform(-5, 5)])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, x double").repartition(4)
    cut = O.cut_by_sketch(df, "x", descending, 200)
    order = [F.desc("x") if descending else F.asc("x"), "id"]
    segs = [r["_seg"] for r in cut.orderBy(*order).collect()]
    assert segs == sorted(segs) and len(set(segs)) >= 12 and cut.count() == 3000
    want = [r["id"] for r in df.orderBy(*order).collect()]
    ranked = O.global_rank(df, "x", "id", descending=descending, rows_per_segment=200)
    assert [r["id"] for r in ranked.orderBy("row_num").collect()] == want
    assert O.cut_by_sketch(df.withColumn("x", F.lit(1.0)), "x", descending, 200) is None
    assert O.cut_by_sketch(df.selectExpr("id", "CAST(x AS STRING) AS x"), "x", descending, 200) is None

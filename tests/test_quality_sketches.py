from __future__ import annotations

import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skyfold.operators import featurize as X
from skyfold.operators import quality as Q
from skyfold.operators import relational as R
from skyfold.operators import reports as P
from skyfold.session import stored_measured
from tests.conftest import rows


def test_pairwise_correlations_against_pairs_alone(spark):
    rnd = random.Random(9)
    data = [tuple(rnd.choice([None, 1e6 + rnd.random(), 1e6 + rnd.random()]) for _ in range(6)) + (5.0,) for _ in range(200)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(7)))
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in Q.correlations(df, df.columns).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            want = df.agg(F.corr(f"c{i}", f"c{j}")).first()[0]
            assert got[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-6)
        assert got[f"c{i}", "c6"] is None
    assert all(r["correlation"] is None for r in Q.correlations(df.limit(0), df.columns).collect())


def test_observed_metrics_equal_a_scan(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, NULL, id) AS a", "IF(id % 7 = 0, NULL, 'x') AS b").repartition(5)
    kept, seen = stored_measured(df, Q.null_metrics(df))
    assert {c: seen[f"nulls_{c}"] for c in df.columns} == {r["column_name"]: r["null_count"] for r in Q.null_profile(kept).collect()}
    _, seen = stored_measured(df.limit(0), Q.null_metrics(df))
    assert all(v == 0 for v in seen.values())


def test_sketches_merge(spark):
    df = spark.range(30_000).selectExpr("id % 5 AS day", "id % 9000 AS k", "IF(id % 2 = 0, NULL, 'x') AS s")
    kept = Q.distinct_sketches(df, ["k", "s"], ["day"])
    whole = Q.merged_distinct(kept, ["k", "s"]).first()
    assert abs(whole["k"] - 9000) < 600 and whole["s"] == 1
    assert {r["day"] for r in Q.merged_distinct(kept, ["k"], ["day"]).collect()} == set(range(5))


def test_nearest_row_without_sorting_rows(spark):
    data = [("a", 2.0, "x", 1), ("a", 1.0, "z", 2), ("a", 1.0, "y", 3), ("b", None, "q", 4), ("b", None, "p", 5), (None, 3.0, "x", 6), ("c", None, "w", 7), ("c", 9.0, "v", 8), ("d", math.nan, "u", 9)]
    df = spark.createDataFrame(data, "k string, d double, t string, v int")
    out = R.nearest_per_key(df, "k", "d", "t")
    assert out.columns == df.columns and sorted(r["v"] for r in out.collect()) == [3, 5, 6, 8, 9]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
    dim = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("c", 5, None)], "k string, o int, name string")
    got = R.lookup_first(df.select("k", "v"), dim, "k", "k", {"name": "first"}, "o")
    assert {r["first"] for r in got.filter("k = 'a'").collect()} == {"one"} and got.count() == 9


def test_built_features_equal_fitted_ones(spark):
    """Models from statistics against the library's own estimators fitted on the rows, group by group; one scan, one pass."""
    rnd = random.Random(3)
    data = [(i % 2, float(rnd.randint(0, 9)), 2.0 ** rnd.randint(0, 12), rnd.choice("abcde"), rnd.choice([1, 2, 3]), i % 3 == 0, int(rnd.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(data, "fold int, n double, s double, c string, q int, f boolean, y int").withColumn("f", F.col("f").cast("int"))
    table = df.withColumn("role", F.when(F.col("n") < 7, "train").otherwise("val")).withColumn("c", F.when((F.col("role") == "val") & (F.col("c") == "e"), "new").otherwise(F.col("c")))
    cfg = X.FeatureConfig(["n", "s"], ["c", "q"], ["f"], ["s"], label="y")
    done = X.fit_apply_groups(cfg, table, ["fold"], [(0,), (1,), (2,)], "role", ["n", "s", "c", "q"])
    for (k,), (_, stats, train, val) in done.items():
        rows_k = X.flags_to_double(table.filter(F.col("fold") == k), ["f"]).withColumn("s_log", F.log1p("s"))
        one = rows_k.filter("role = 'train'")
        if k == 2:
            assert train.count() == val.count() == 0 and stats.positives == 0
            continue
        pipeline = Pipeline(stages=[
            StringIndexer(inputCols=["c", "q"], outputCols=["ci", "qi"], handleInvalid="keep"), OneHotEncoder(inputCols=["ci", "qi"], outputCols=["co", "qo"]),
            VectorAssembler(inputCols=["n", "s_log"], outputCol="num"), StandardScaler(inputCol="num", outputCol="sc", withMean=True, withStd=True),
            VectorAssembler(inputCols=["sc", "co", "qo", "f"], outputCol="want"),
        ])
        want = pipeline.fit(one).transform(rows_k.filter("role = 'val'")).select(vector_to_array("want").alias("v"))
        for a, b in zip(rows(val.select(vector_to_array("log_scaled_features").alias("v"))), rows(want), strict=True):
            assert a[0] == pytest.approx(b[0], abs=1e-9)
        assert train.filter("y = 1").count() == stats.positives and train.filter("y = 0").count() < stats.negatives
    plan = X.feature_statistics(table, cfg, ["fold"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_cube_reads_like_single_reports(spark):
    df = spark.range(500).selectExpr("id % 3 AS a", "IF(id % 11 = 0, NULL, id % 4) AS b", "IF(id % 13 = 0, NULL, CAST(id % 2 AS INT)) AS late", "CAST(id AS DOUBLE) AS m")
    cube = P.rate_cube(df, [["a"], ["b"], ["a", "b"], []], "late", {"minutes": F.col("m")})
    for keys in (["a"], ["b"], ["a", "b"]):
        assert rows(P.rates_from(cube, keys, min_total=20)) == rows(P.rate_by(df, keys, "late", min_total=20))
        assert rows(P.means_from(cube, keys)) == rows(P.mean_flag_by(df, keys, "late"))
    assert P.rates_from(cube, [], sums=["minutes"]).first()["minutes"] == sum(range(500))

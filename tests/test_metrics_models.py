from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skyfold.operators import metrics as M
from skyfold.operators import models as ML
from tests.conftest import rows


def brute_metrics(data):
    """Trapezoid PR area, average precision and rank AUC by definition."""
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    points, ap, area = [], 0.0, 0.0
    for t in sorted({s for s, _ in data}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        points.append((tp / len(pos), tp / (tp + fp)))
    last_r, last_p = 0.0, points[0][1]
    for r, p in points:
        ap += (r - last_r) * p
        area += (r - last_r) * (p + last_p) / 2
        last_r, last_p = r, p
    return area, ap, auc


@pytest.mark.parametrize("levels", [3, 1000])
def test_areas(spark, levels):
    rng = random.Random(levels)
    data = [(round(rng.random() * levels) / levels, int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(data, "score double, y int").repartition(4)
    r = M.ranking_metrics(df, "score", "y").first()
    for got, want in zip((r["pr_auc"], r["average_precision"], r["roc_auc"]), brute_metrics(data), strict=True):
        assert abs(got - want) < 1e-9
    preds = df.withColumn("rawPrediction", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    for name, mine in (("areaUnderPR", r["pr_auc"]), ("areaUnderROC", r["roc_auc"])):
        theirs = BinaryClassificationEvaluator(labelCol="y", metricName=name, numBins=0).evaluate(preds)
        assert abs(theirs - mine) < 1e-9


def test_one_class_and_negative_predictions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1), (0.0, 0.0, 1), (0.0, 0.0, 0)], "score double, prediction double, y int")
    r = M.confusion(df, "y").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], r["f2"]) == (0, 0, 2, 1, 0.0, 0.0, 0.0)
    one = M.ranking_metrics(df.filter("y = 1"), "score", "y").first()
    assert one["roc_auc"] is None and one["pr_auc"] == 1.0


@pytest.mark.parametrize(("tp", "fp", "fn", "f2"), [(18760, 78931, 0, 0.5430), (25370, 72321, 0, 0.6369), (0, 0, 25598, 0.0), (16472, 81222, 0, 0.5035)])
def test_recorded_baseline_scores(spark, tp, fp, fn, f2):
    df = spark.createDataFrame([(tp, fp, fn)], "tp bigint, fp bigint, fn bigint")
    assert round(df.select(M.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0)).first()[0], 4) == f2


def test_majority_baseline(spark):
    train = spark.createDataFrame([(1,)] * 3 + [(0,)] * 2, "y int")
    val = spark.createDataFrame([(1,), (0,), (0,)], "y int")
    got = M.cv_eval(ML.majority_baseline(train, val, "y"), "y")
    assert (got["tp"], got["fp"], got["recall"], got["pr_auc"]) == (1, 2, 1.0, 0.3333)
    zero = M.cv_eval(ML.majority_baseline(val, train, "y"), "y")
    assert (zero["fn"], zero["tn"], zero["pr_auc"]) == (3, 2, 0.6)
    tie = spark.createDataFrame([(1,), (0,)], "y int")
    assert ML.majority_baseline(tie, val, "y").first()["prediction"] == 0.0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    data = []
    for _ in range(400):
        x = rng.random()
        data.append((x, rng.random(), int(x + rng.gauss(0, 0.1) > 0.6), rng.randrange(2) + 1))
    return spark.createDataFrame(data, "x double, noise double, y int, fold int").cache()


def test_grid_and_best(spark, table):
    folds = [(k, table.filter(F.col("fold") != k), table.filter(F.col("fold") == k)) for k in (1, 2)]
    grid = {"numTrees": [2], "maxDepth": [1, 3]}
    found = ML.grid_on_folds(folds, grid, ML.rf_builder("y", ["x", "noise"]), "y")
    assert found.count() == 4 and found.filter("pr_auc > 0.8").count() >= 2
    best = ML.best_params(found, ["numTrees", "maxDepth"], "f2").first()
    mean = found.groupBy("maxDepth").agg(F.avg("f2").alias("m")).agg(F.max("m")).first()[0]
    assert abs(best["f2_mean"] - mean) < 1e-12
    assert ML.best_params(found, ["maxDepth"], "recall", how="max").first()["recall_max"] == found.agg(F.max("recall")).first()[0]
    with pytest.raises(ValueError, match="no folds"):
        ML.grid_on_folds([], grid, ML.rf_builder("y", ["x"]), "y")


def test_importance_and_blind_test(spark, table):
    build = ML.gbt_builder("y", ["x", "noise"])
    model, found = ML.blind_test(build, {"maxIter": 3, "maxDepth": 2}, table.filter("fold = 1"), table.filter("fold = 2"), "y")
    assert found["roc_auc"] > 0.9
    top = ML.feature_importance(model, model.transform(table)).orderBy(F.desc("importance")).collect()
    assert top[0]["feature"] == "x" and abs(top[-1]["cumulative_share"] - 100) < 1e-6


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0.5, 0.9), ("a", 0.7, 0.75)], "p string, val double, train double")
    r = M.fold_summary(df, ["val"], ["p"]).first()
    assert abs(r["val_mean"] - 0.6) < 1e-12 and abs(r["val_std"] - 0.1) < 1e-12
    assert [x["overfit"] for x in M.overfit_gap(df, "train", "val").orderBy("val").collect()] == [True, False]
    assert rows(M.best_by(df, "val")) == [("a", 0.7, 0.75)]

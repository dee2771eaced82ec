"""Classifier metrics computed by aggregates; predictions never leave Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from skyfold.operators.ordered import totals_by_value


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    return _ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def confusion(preds: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN with precision, recall, F1, F2 and accuracy, in one aggregate (per group with ``by``)."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = preds.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": f_beta(tp, fp, fn, 1.0),
            "f2": f_beta(tp, fp, fn, 2.0),
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def with_score(preds: DataFrame, probability: str = "probability", score: str = "score") -> DataFrame:
    """The probability of class 1 as a plain column."""
    return preds.withColumn(score, vector_to_array(probability)[1])


def pr_curve(preds: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score, highest first: running true and false positives, precision, recall."""
    y = F.col(label) == 1
    known = preds.filter(F.col(label).isNotNull())
    sums = {"tp": F.when(y, 1).otherwise(0).cast("bigint"), "fp": F.when(y, 0).otherwise(1).cast("bigint")}
    curve = totals_by_value(known.select(score, label), score, sums, descending=True)
    positives = known.filter(F.col(score).isNotNull()).agg(F.count_if(y)).scalar()
    return curve.withColumns(
        {
            "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
            "recall": F.col("tp") / F.nullif(positives, F.lit(0)),
        }
    )


def ranking_metrics(preds: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Areas under the curves, exact over every distinct score, per group with ``by``.

    ``pr_auc`` joins the points of the precision-recall curve by straight lines, starting at recall 0
    with the first precision; ``average_precision`` adds up steps; ``roc_auc`` is the rank statistic
    with ties counted half. The three differ, so they carry different names.

    A point recovers the one before it by taking off its own counts, so no second ordering is needed.
    """
    y = F.col(label) == 1
    known = preds.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sums = {"tp": F.when(y, one).otherwise(zero), "fp": F.when(y, zero).otherwise(one)}
    pts = totals_by_value(known.select(*by, score, label), score, sums, descending=True, own=True, by=by)
    tp, fp, dp, dn = F.col("tp"), F.col("fp"), F.col("own_tp"), F.col("own_fp")
    before_n = tp + fp - dp - dn
    precision = tp / (tp + fp)
    before = F.when(before_n > 0, (tp - dp) / before_n).otherwise(precision)
    totals = pts.groupBy(*by).agg(
        F.sum(dp).alias("positives"),
        F.sum(dn).alias("negatives"),
        F.sum(dp * (precision + before) / 2).alias("_trapezoid"),
        F.sum(dp * precision).alias("_steps"),
        F.sum(dn * (tp - dp) + dn * dp / 2).alias("_wins"),
    )
    p, q = F.nullif(F.col("positives"), F.lit(0)), F.nullif(F.col("negatives"), F.lit(0))
    return totals.select(
        *by,
        "positives",
        "negatives",
        (F.col("_trapezoid") / p).alias("pr_auc"),
        (F.col("_steps") / p).alias("average_precision"),
        (F.col("_wins") / (p.cast("double") * q)).alias("roc_auc"),
    )


# Metric columns of one evaluation.
EVAL_SCHEMA = (
    "f2 double, pr_auc double, precision double, recall double, tp bigint, fp bigint, fn bigint, tn bigint, "
    "f1 double, accuracy double, average_precision double, roc_auc double"
)


def tagged_eval(preds: DataFrame, label: str, by: Sequence[str], digits: int | None = 4) -> DataFrame:
    """``cv_eval`` of many sets of predictions at once, told apart by ``by``: one aggregate for the cells of all, one ordering for all curves.

    ``preds`` has ``by``, the label, ``prediction`` and ``score`` and should be stored, as both read it.
    """
    known = preds.filter(F.col(label).isNotNull())
    ranks = ranking_metrics(known, "score", label, by).drop("positives", "negatives")
    found = confusion(known, label, by=by).join(ranks, list(by))
    fields = T.StructType.fromDDL(EVAL_SCHEMA).fields
    exact = {f.name for f in fields if f.dataType == T.LongType()} if digits is not None else {f.name for f in fields}
    return found.select(*by, *[F.col(f.name) if f.name in exact else F.round(f.name, digits).alias(f.name) for f in fields])


def cv_eval(preds: DataFrame, label: str, digits: int | None = 4) -> dict[str, float | int]:
    """F2, PR-AUC, precision, recall, confusion counts and more of one set of predictions.

    Scores are kept (three narrow columns) while the metrics read them, so the model runs once.
    """
    scored = with_score(preds.select(F.col(label), "prediction", "probability")).select(label, "prediction", "score")
    known = scored.filter(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = confusion(known, label).first().asDict() | ranking_metrics(known, "score", label).first().asDict()
    finally:
        known.unpersist()
    names = T.StructType.fromDDL(EVAL_SCHEMA).names
    return {
        n: round(row[n], digits) if isinstance(row[n], float) and digits is not None else row[n] for n in names
    }


def evaluate(preds: DataFrame, label: str, metrics: Sequence[str]) -> dict[str, float]:
    """Metrics by Spark's own evaluators: any of recall, precision, f1, f2, pr_auc, roc_auc, log_loss."""
    multi = {
        "recall": {"metricName": "recallByLabel", "metricLabel": 1.0},
        "precision": {"metricName": "precisionByLabel", "metricLabel": 1.0},
        "f1": {"metricName": "f1"},
        "f2": {"metricName": "fMeasureByLabel", "metricLabel": 1.0, "beta": 2.0},
        "log_loss": {"metricName": "logLoss"},
    }
    binary = {"pr_auc": "areaUnderPR", "roc_auc": "areaUnderROC"}
    kept = preds.select(*[c for c in (label, "prediction", "probability", "rawPrediction") if c in preds.columns]).persist()
    found = {}
    try:
        for m in metrics:
            if m in binary:
                evaluator = BinaryClassificationEvaluator(labelCol=label, metricName=binary[m])
            else:
                evaluator = MulticlassClassificationEvaluator(labelCol=label, **multi[m])
            found[m] = evaluator.evaluate(kept)
    finally:
        kept.unpersist()
    return found


def fold_summary(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of fold metrics, per parameter set with ``by``."""
    aggs = [f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return metrics.groupBy(*by).agg(*aggs)


def overfit_gap(metrics: DataFrame, train: str, val: str, limit: float = 0.1) -> DataFrame:
    """Training metric minus validation metric and whether it exceeds the limit."""
    gap = F.col(train) - F.col(val)
    return metrics.withColumns({"gap": gap, "overfit": gap > limit})


def best_by(metrics: DataFrame, measure: str, *tie: str) -> DataFrame:
    """The row with the largest measure."""
    w = F.struct(F.col(measure), *[F.struct(F.col(t)) for t in tie])
    return metrics.agg(F.max_by(F.struct(*metrics.columns), w).alias("_b")).select("_b.*")


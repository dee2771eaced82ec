"""Queries for feature pipelines, classifiers and their evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.catalog.domain import _FOLDS
from skyfold.catalog.base import legs, query, rounded, table
from skyfold.operators import featurize as X
from skyfold.operators import metrics as M
from skyfold.operators import models as ML
from skyfold.operators import splits as SP
from skyfold.operators.features import flags_to_double
from skyfold.operators.reports import mean_metrics as mean_by_params
from skyfold.session import scratch_path, shuffles_dropped, stored
from skyfold.sources import tables as S

# ---------------------------------------------------------------- feature stages


@query(
    """WITH k AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i
      FROM customer GROUP BY 1)
    SELECT c_custkey, CAST(i AS DOUBLE) AS c_mktsegment_idx FROM customer JOIN k ON c_mktsegment = s"""
)
def string_index(spark: SparkSession, sf: str) -> DataFrame:
    """Indices of the market segments, most frequent first."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    model = X.index_stage(["c_mktsegment"]).fit(customer)
    return model.transform(customer).select("c_custkey", "c_mktsegment_idx")


@query(
    """WITH k AS (SELECT o_orderpriority AS s, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
      FROM orders WHERE o_orderpriority NOT IN ('5-LOW') GROUP BY 1)
    SELECT o_orderkey, CAST(coalesce(i, 4) AS DOUBLE) AS o_orderpriority_idx FROM orders LEFT JOIN k ON o_orderpriority = s"""
)
def string_index_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """A value missing from the training rows gets the extra bucket."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    model = X.index_stage(["o_orderpriority"]).fit(orders.filter("o_orderpriority <> '5-LOW'"))
    return model.transform(orders).select("o_orderkey", "o_orderpriority_idx")


@query(
    """WITH k AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i
      FROM customer GROUP BY 1)
    SELECT c_custkey, """
    + ", ".join(f"CAST(i = {j} AS DOUBLE) AS slot_{j}" for j in range(5))
    + " FROM customer JOIN k ON c_mktsegment = s"
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    cols = ["c_mktsegment"]
    coded = Pipeline(stages=[X.index_stage(cols), X.one_hot_stage(cols)]).fit(customer).transform(customer)
    slots = vector_to_array("c_mktsegment_ohe")
    return coded.select("c_custkey", *[F.get(slots, F.lit(j)).alias(f"slot_{j}") for j in range(5)])


_EVENT_SKEW = "(SELECT avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) FROM events, (SELECT avg(value) AS m FROM events))"


@query(
    f"""SELECT event_id, value, round(CASE WHEN abs({_EVENT_SKEW}) > 1 THEN sign(value) * ln(1 + abs(value)) END, 6)
    AS value_log FROM events"""
)
def skew_log(spark: SparkSession, sf: str) -> DataFrame:
    """A signed-log twin for skewed columns only."""
    events = table(spark, sf, "events").select("event_id", "value")
    return rounded(X.SkewLog(["value"]).fit(events).transform(events), "value_log")


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6) AS {c}_num"
        for c in _NUM
    )
    + """, CAST(i AS INTEGER) AS l_returnflag_cat, CAST(l_linenumber % 2 AS FLOAT) AS odd_bin,
      CAST(l_linestatus = 'O' AS FLOAT) AS target
    FROM lineitem JOIN (SELECT l_returnflag AS s, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS i
      FROM lineitem GROUP BY 1) ON l_returnflag = s"""
)
def scaled_flat_export(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised numerics, indexed categories, flags and the label as plain columns."""
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = table(spark, sf, "lineitem").withColumns(
        {"odd": F.col("l_linenumber") % 2, "label": (F.col("l_linestatus") == "O").cast("int")}
    )
    model = X.per_column_pipeline(_NUM, ["l_returnflag"]).fit(df)
    scored = model.transform(df)
    flat = X.flat_export(scored.select("_scaled", "l_returnflag_idx2", "odd", "label", *ids), _NUM, ["l_returnflag"], ["odd"], "label", ids)
    return rounded(flat, *[f"{c}_num" for c in _NUM])


@query(
    """SELECT 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) + 1 AS n FROM lineitem
    UNION ALL SELECT 'l_linestatus', 12 FROM lineitem GROUP BY 1"""
)
def index_cardinalities(spark: SparkSession, sf: str) -> DataFrame:
    """Index sizes of a fitted pipeline, one of them imposed."""
    model = X.per_column_pipeline(_NUM, ["l_returnflag", "l_linestatus"]).fit(table(spark, sf, "lineitem"))
    found = X.cardinalities(model, {"l_linestatus": 12, "absent": 4})
    return spark.createDataFrame(list(found.items()), "column_name string, n bigint")


def _model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Legs with a known label, as a feature table."""
    df = legs(spark, sf, dest=False).filter("ARR_DEL15 IS NOT NULL")
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "FL_DATE", "DISTANCE", "CRS_ELAPSED_TIME", "DEP_DELAY",
        "CRS_DEP_HOUR", "DEP_DEL15", "OP_UNIQUE_CARRIER", "ORIGIN", "ARR_DEL15",
        (F.col("ARR_DELAY") + F.col("l_suppkey") % 40 - 20).alias("NOISY_DELAY"),
    )


_CFG = X.FeatureConfig(
    numeric=["DISTANCE", "CRS_ELAPSED_TIME", "DEP_DELAY", "NOISY_DELAY"],
    categorical=["OP_UNIQUE_CARRIER"],
    flags=["DEP_DEL15"],
    log_candidates=["DISTANCE", "DEP_DELAY"],
)

_VEC_NUM = sorted(_CFG.numeric)


@query(
    """WITH f AS (SELECT *, "ARR_DELAY" + l_suppkey % 40 - 20 AS "NOISY_DELAY" FROM legs WHERE "ARR_DEL15" IS NOT NULL),
    t AS (SELECT * FROM f WHERE "FL_DATE" < DATE '1999-01-01'),
    k AS (SELECT "OP_UNIQUE_CARRIER" AS s, row_number() OVER (ORDER BY count(*) DESC, "OP_UNIQUE_CARRIER") - 1 AS i
      FROM t GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, """
    + ", ".join(
        f"""round(("{c}" - (SELECT avg("{c}") FROM t)) / (SELECT stddev_samp("{c}") FROM t), 6) AS scaled_{i}, "{c}" AS raw_{i}"""
        for i, c in enumerate(_VEC_NUM)
    )
    + ", "
    + ", ".join(f"CAST(i = {j} AS DOUBLE) AS ohe_{j}" for j in range(5))
    + """, CAST("DEP_DEL15" AS DOUBLE) AS flag FROM f JOIN k ON "OP_UNIQUE_CARRIER" = s WHERE "FL_DATE" >= DATE '1999-01-01'""",
    legs=True,
)
def final_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled and raw final vectors of later legs, everything fitted on earlier ones."""
    df = _model_table(spark, sf)
    cut = F.lit(dt.date(1999, 1, 1))
    _, _, done = X.fit_apply(_CFG, df.filter(F.col("FL_DATE") < cut), {"val": df.filter(F.col("FL_DATE") >= cut)})
    scaled, raw = vector_to_array("log_scaled_features"), vector_to_array("full_unscaled_features")
    n = len(_VEC_NUM)
    out = done["val"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[F.get(scaled, F.lit(i)).alias(f"scaled_{i}") for i in range(n)],
        *[F.get(raw, F.lit(i)).alias(f"raw_{i}") for i in range(n)],
        *[F.get(raw, F.lit(n + j)).alias(f"ohe_{j}") for j in range(5)],
        F.get(raw, F.lit(n + 5)).alias("flag"),
    )
    return rounded(out, *[f"scaled_{i}" for i in range(n)])


@query(
    """WITH k AS (SELECT "OP_UNIQUE_CARRIER" AS s, row_number() OVER (ORDER BY count(*) DESC, "OP_UNIQUE_CARRIER") - 1 AS i
      FROM legs WHERE "ARR_DEL15" IS NOT NULL GROUP BY 1)
    SELECT CAST(4 + i AS INTEGER) AS idx, 'ohe_vector_OP_UNIQUE_CARRIER_ohe_' || s AS name FROM k
    UNION ALL SELECT * FROM (VALUES (0, 'num_vector_CRS_ELAPSED_TIME'), (1, 'num_vector_DEP_DELAY'),
      (2, 'num_vector_DISTANCE'), (3, 'num_vector_NOISY_DELAY'), (9, 'DEP_DEL15'))""",
    legs=True,
)
def vector_slot_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the slots of a fitted vector, from its metadata."""
    df = _model_table(spark, sf)
    model = X.fit_features(_CFG, df)
    slots = X.vector_slots(model.transform(flags_to_double(df, _CFG.flags)), "log_unscaled_features")
    return spark.createDataFrame(slots, "idx int, name string")


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n_rows, CAST(1 AS BIGINT) AS slots, CAST(1 AS INTEGER) AS set_slots,
      (SELECT count(DISTINCT l_partkey) > 50 FROM lineitem) AS spread FROM lineitem GROUP BY 1"""
)
def hashed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed vectors of a high-cardinality id: one slot is set, equal ids share it, and many slots are in use."""
    df = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    hashed = X.hash_stage(["part"], "hashed").transform(df).withColumn("_v", vector_to_array("hashed"))
    slots = hashed.select("part", F.size(F.filter("_v", lambda x: x != 0)).alias("_n"), F.array_position("_v", 1.0).alias("_slot"))
    per_id = stored(slots.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("_slot").alias("slots"), F.max("_n").alias("set_slots"), F.min("_slot").alias("_s")), "slots")
    spread = per_id.agg(F.count_distinct("_s") > 50).scalar()
    return per_id.select("part", "n_rows", "slots", "set_slots", spread.alias("spread"))


@query(
    """WITH c AS (SELECT 'supplier ' || l_suppkey AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1),
    s AS (SELECT *, 100.0 * importance / sum(importance) OVER () AS share,
      100.0 * sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)
        / sum(importance) OVER () AS cumulative_share FROM c)
    SELECT feature, importance, round(share, 6) AS share, round(cumulative_share, 6) AS cumulative_share
    FROM s WHERE cumulative_share - share < 80"""
)
def select_by_share(spark: SparkSession, sf: str) -> DataFrame:
    """The items that make up the first 80 percent of the total."""
    items = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("supplier "), "l_suppkey").alias("feature")).agg(
        F.sum("l_quantity").alias("importance")
    )
    return rounded(X.select_by_share(items, 80.0), "share", "cumulative_share")


@query(
    """WITH k AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i
      FROM customer GROUP BY 1)
    SELECT c_custkey, CAST(i AS DOUBLE) AS c_mktsegment_idx FROM customer JOIN k ON c_mktsegment = s"""
)
def saved_feature_model(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted pipeline saved, loaded and applied."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    path = scratch_path(spark, "model")
    S.save_model(Pipeline(stages=[X.index_stage(["c_mktsegment"])]).fit(customer), path)
    return S.load_model(path).transform(customer).select("c_custkey", "c_mktsegment_idx")


# ---------------------------------------------------------------- evaluation

_PREDS = """p AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value,
    CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END AS prediction, user_id % 4 AS fold, event_id FROM events)"""


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    """Events as predictions of errors: the value is the score."""
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        "value",
        (F.col("value") > 30).cast("double").alias("prediction"),
        (F.col("user_id") % 4).alias("fold"),
    )


_CELLS = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"""
_SCORES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round(2.0 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1, round(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f2,
      round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"""
_SCORE_COLS = ["precision", "recall", "f1", "f2", "accuracy"]


@query(f"WITH {_PREDS}, c AS (SELECT {_CELLS} FROM p) SELECT *, {_SCORES} FROM c")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.confusion(_preds(spark, sf), "label"), *_SCORE_COLS)


@query(
    f"""WITH {_PREDS}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY 1),
    s AS (SELECT 5.0 * tp / (5 * tp + 4 * fn + fp) AS f2, tp / (tp + fn) AS recall FROM c)
    SELECT round(avg(f2), 6) AS f2_mean, round(stddev_pop(f2), 6) AS f2_std, round(avg(recall), 6) AS recall_mean,
      round(stddev_pop(recall), 6) AS recall_std FROM s"""
)
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of fold metrics, all folds evaluated in one aggregate."""
    folds = M.confusion(_preds(spark, sf), "label", by=["fold"])
    return rounded(M.fold_summary(folds, ["f2", "recall"]), "f2_mean", "f2_std", "recall_mean", "recall_std")


@query(
    f"""WITH {_PREDS}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY 1),
    s AS (SELECT fold, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)
    SELECT fold, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(accuracy - recall, 6) AS gap,
      accuracy - recall > 0.1 AS overfit FROM s"""
)
def overfit_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of two metrics per fold against a limit."""
    folds = M.confusion(_preds(spark, sf), "label", by=["fold"]).select("fold", "accuracy", "recall")
    return rounded(M.overfit_gap(folds, "accuracy", "recall"), "accuracy", "recall", "gap")


_CURVE = f"""{_PREDS}, d AS (SELECT value, sum(label) AS dp, count(*) - sum(label) AS dn FROM p GROUP BY 1),
    v AS (SELECT *, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER () AS np, sum(dn) OVER () AS nn
      FROM d WINDOW w AS (ORDER BY value DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    f"""WITH {_CURVE} SELECT value, CAST(tp AS BIGINT) AS tp,
    CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM v"""
)
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    return rounded(M.pr_curve(_preds(spark, sf), "value", "label"), "precision", "recall")


@query(
    f"""WITH {_CURVE}, z AS (SELECT *, tp / (tp + fp) AS pr, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY value DESC),
      tp / (tp + fp)) AS pp FROM v)
    SELECT CAST(any_value(np) AS BIGINT) AS positives, CAST(any_value(nn) AS BIGINT) AS negatives,
      round(sum(dp * (pr + pp) / 2) / any_value(np), 6) AS pr_auc, round(sum(dp * pr) / any_value(np), 6) AS average_precision,
      round(sum(dn * (tp - dp) + dn * dp / 2) / (any_value(np)::DOUBLE * any_value(nn)), 6) AS roc_auc FROM z"""
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    """Areas under both curves and the average precision."""
    return rounded(M.ranking_metrics(_preds(spark, sf), "value", "label"), "pr_auc", "average_precision", "roc_auc")


@query(
    f"""WITH {_PREDS}, q AS (SELECT *, least(value / 1000, 1) AS s FROM p), c AS (SELECT {_CELLS} FROM q)
    SELECT round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision,
      round((2.0 * tp / (2 * tp + fn + fp) * (tp + fn) + 2.0 * tn / (2 * tn + fn + fp) * (tn + fp)) / (tp + fp + fn + tn), 6) AS f1,
      round(5.0 * tp / (5 * tp + 4 * fn + fp), 6) AS f2,
      round((SELECT avg(-ln(greatest(least(CASE WHEN label = 1 THEN s ELSE 1 - s END, 1 - 1e-15), 1e-15))) FROM q), 6) AS log_loss
    FROM c"""
)
def evaluator_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by Spark's evaluators."""
    score = F.least(F.col("value") / 1000, F.lit(1.0))
    preds = _preds(spark, sf).withColumn("probability", array_to_vector(F.array(1 - score, score)))
    names = ["recall", "precision", "f1", "f2", "log_loss"]
    found = M.evaluate(preds, "label", names)
    return rounded(spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names)), *names)


@query(
    f"""WITH {_PREDS} SELECT fold, round(avg(value), 6) AS value, round(avg(prediction), 6) AS prediction FROM p GROUP BY 1"""
)
def mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of measures per parameter value."""
    return rounded(mean_by_params(_preds(spark, sf), ["fold"], ["value", "prediction"]), "value", "prediction")


@query(
    f"""WITH {_PREDS}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY 1), s AS (SELECT *, {_SCORES} FROM c)
    SELECT fold, f2, recall FROM s"""
)
def metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    """Run records appended to a metrics table and read back."""
    path = scratch_path(spark, "metrics")
    folds = rounded(M.confusion(_preds(spark, sf), "label", by=["fold"]), "f2", "recall")
    rows = [r.asDict() for r in folds.select("fold", "f2", "recall").orderBy("fold").collect()]  # a row per run
    for run in (rows[:1], rows[1:]):
        S.append_metrics(spark, path, run, "fold bigint, f2 double, recall double")
    return S.read_parquet(spark, path)


@query(
    f"""WITH {_PREDS}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY 1)
    SELECT CAST(fold AS VARCHAR) AS fold, round(5.0 * tp / (5 * tp + 4 * fn + fp), 6) AS f2_mean, 0.0::DOUBLE AS f2_std
    FROM c ORDER BY f2_mean DESC, fold LIMIT 1"""
)
def best_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The parameter value with the best mean metric."""
    folds = M.confusion(_preds(spark, sf), "label", by=["fold"]).withColumn("fold", F.col("fold").cast("string"))
    return rounded(ML.best_params(folds, ["fold"], "f2"), "f2_mean", "f2_std")


@query(
    """WITH f AS (SELECT "FL_DATE" AS d, "ARR_DEL15" AS y FROM legs WHERE "ARR_DEL15" IS NOT NULL),
    m AS (SELECT y AS major FROM f WHERE d < DATE '1999-01-01' GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1),
    p AS (SELECT y AS label, CAST(major AS DOUBLE) AS prediction FROM f, m WHERE d >= DATE '1999-01-01'),"""
    + f" c AS (SELECT {_CELLS} FROM p) SELECT * EXCLUDE (f1, f2), coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM (SELECT *, {_SCORES} FROM c)",
    legs=True,
)
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Later legs predicted as the majority class of earlier ones."""
    df = legs(spark, sf, carrier=False, origin=False, dest=False).filter("ARR_DEL15 IS NOT NULL")
    df = df.select("FL_DATE", "ARR_DEL15")
    cut = F.lit(dt.date(1999, 1, 1))
    preds = ML.majority_baseline(df.filter(F.col("FL_DATE") < cut), df.filter(F.col("FL_DATE") >= cut), "ARR_DEL15")
    return rounded(M.confusion(preds, "ARR_DEL15"), *_SCORE_COLS)


@query(
    f"""WITH {_FOLDS}, r AS (SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN o_orderdate < b THEN 'train' ELSE 'val' END AS role
      FROM orders JOIN f ON o_orderdate >= a AND o_orderdate < c)
    SELECT fold, role, count(*) AS n FROM r GROUP BY 1, 2"""
)
def fold_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Folds written as partitions of one table, discovered and counted from it."""
    orders = table(spark, sf, "orders")
    folds = SP.rolling_folds(*SP.day_range(orders, "o_orderdate"), SP.FoldSpec(24, 12, 12))
    path = scratch_path(spark, "folds")
    S.write_partitioned(SP.assign_folds(orders, "o_orderdate", folds), path, ["fold", "role"])
    stored = S.read_parquet(spark, path)
    return stored.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- classifiers

_FEATURES = ["DISTANCE", "CRS_ELAPSED_TIME", "DEP_DELAY", "NOISY_DELAY", "CRS_DEP_HOUR"]


def _folds(spark: SparkSession, sf: str) -> list[tuple[int, DataFrame, DataFrame]]:
    """All rolling folds of the model table, which is worked out twice whatever their number: for its days, and to be written in a folder per fold
    and role. Class counts and both sides of a fold read their own folders."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    with shuffles_dropped(spark):
        df = _model_table(spark, sf).select(*keys, "FL_DATE", *_FEATURES, "ARR_DEL15")
        folds = SP.rolling_folds(*SP.day_range(df, "FL_DATE"), SP.FoldSpec(24, 12, 12))
        long = stored(SP.assign_folds(df, "FL_DATE", folds), "folds", ["fold", "role"])

    def part(k: int, role: str) -> DataFrame:
        return long.filter((F.col("fold") == k) & (F.col("role") == role))

    return [(f.number, SP.downsample(part(f.number, "train"), "ARR_DEL15", keys), part(f.number, "val")) for f in folds]


@query()
def rf_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Random forests over a small grid and all rolling folds."""
    build = ML.rf_builder("ARR_DEL15", _FEATURES)
    grid = {"numTrees": [20], "maxDepth": [3, 5], "maxBins": [400]}
    return ML.grid_on_folds(_folds(spark, sf), grid, build, "ARR_DEL15")


@query()
def gbt_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees over a small grid and all rolling folds."""
    build = ML.gbt_builder("ARR_DEL15", _FEATURES)
    grid = {"maxIter": [20], "stepSize": [0.1, 0.3], "maxDepth": [3]}
    return ML.grid_on_folds(_folds(spark, sf), grid, build, "ARR_DEL15")


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of a weighted forest on a prebuilt vector, with shares."""
    df = SP.add_class_weights(_model_table(spark, sf), "ARR_DEL15")
    features, train, _ = X.fit_apply(_CFG, df, {})
    build = ML.rf_builder("ARR_DEL15", "log_unscaled_features", weight="weight")
    model = build({"numTrees": 20, "maxDepth": 4}).fit(train)
    return ML.feature_importance(model, model.transform(train))


@query()
def blind_test_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Final fit on all earlier legs, metrics on later ones never looked at before."""
    df = _model_table(spark, sf)
    cut = F.lit(dt.date(1999, 1, 1))
    build = ML.rf_builder("ARR_DEL15", _FEATURES)
    _, found = ML.blind_test(
        build, {"numTrees": 20, "maxDepth": 5}, df.filter(F.col("FL_DATE") < cut), df.filter(F.col("FL_DATE") >= cut),
        "ARR_DEL15",
    )
    return spark.createDataFrame([tuple(found.values())], M.EVAL_SCHEMA)


@query()
def random_cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Random two-fold grid search; mean score per parameter set."""
    assembled = X.assemble(_FEATURES, "features").transform(_model_table(spark, sf))
    forest = RandomForestClassifier(labelCol="ARR_DEL15", numTrees=20, seed=42)
    model = ML.random_cv(assembled.select("features", "ARR_DEL15"), forest, {"maxDepth": [2, 4]}, "ARR_DEL15", folds=2)
    depths = [list(p.values())[0] for p in model.getEstimatorParamMaps()]
    return spark.createDataFrame([(d, float(m)) for d, m in zip(depths, model.avgMetrics, strict=True)], "max_depth int, pr_auc double")

"""Feature pipelines on Spark ML: skew-gated logs, indexing, one-hot, scaling, final vectors, exports."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.labels import signed_log
from skyfold.operators.features import flags_to_double
from skyfold.operators.ordered import cumulative_share
from skyfold.operators.splits import keep_balanced


@dataclass(frozen=True)
class SkewLog:
    """Columns that get a signed-log twin ``<col>_log``, chosen on training rows only."""

    cols: Sequence[str]
    threshold: float = 1.0
    chosen: tuple[str, ...] = ()

    def fit(self, train: DataFrame) -> SkewLog:
        """One aggregate over the candidates; a constant or empty column has no skewness and stays out."""
        row = train.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in self.cols]).first()
        chosen = tuple(c for c in self.cols if row[c] is not None and abs(row[c]) > self.threshold)
        return SkewLog(self.cols, self.threshold, chosen)

    @property
    def log_columns(self) -> list[str]:
        return [f"{c}_log" for c in self.chosen]

    def stage(self) -> Transformer:
        """The fitted logs as a pipeline stage, so that they are saved with the pipeline."""
        logs = "".join(f", signum(`{c}`) * log1p(abs(`{c}`)) AS `{c}_log`" for c in self.chosen)
        return SQLTransformer(statement=f"SELECT *{logs} FROM __THIS__")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stage().transform(df)


@dataclass(frozen=True)
class FeatureConfig:
    """Column roles of a feature table."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    flags: Sequence[str] = ()
    log_candidates: Sequence[str] = ()
    label: str = "ARR_DEL15"
    skew_threshold: float = 1.0


#: Between the labels of an index in one text.
_MARK = "\x1f"


def index_stage(cols: Sequence[str], suffix: str = "_idx") -> StringIndexer:
    """All categories indexed in one pass, most frequent first; unseen values share an extra bucket."""
    return StringIndexer(inputCols=list(cols), outputCols=[f"{c}{suffix}" for c in cols], handleInvalid="keep")


def index_model(col: str, labels: Sequence[str], suffix: str = "_idx") -> StringIndexerModel:
    """The fitted index of one column from its labels in order.

    The labels go to the JVM as one text: one call instead of one per label. A label that holds the mark between them, and an only label
    that is empty, go one by one.
    """
    given = {"inputCols": [col], "outputCols": [f"{col}{suffix}"], "handleInvalid": "keep"}
    if labels == [""] or any(_MARK in v for v in labels):
        return StringIndexerModel.from_arrays_of_labels([list(labels)], **given)
    gateway = SparkContext._active_spark_context._gateway
    array = gateway.new_array(gateway.jvm.java.lang.String, 1, 0)
    array[0] = gateway.jvm.org.apache.commons.lang3.StringUtils.splitPreserveAllTokens(_MARK.join(labels), _MARK)
    model = StringIndexerModel._create_from_java_class("org.apache.spark.ml.feature.StringIndexerModel", array)
    return model.setInputCols(given["inputCols"]).setOutputCols(given["outputCols"]).setHandleInvalid(given["handleInvalid"])


def one_hot_stage(cols: Sequence[str], suffix: str = "_idx") -> OneHotEncoder:
    return OneHotEncoder(inputCols=[f"{c}{suffix}" for c in cols], outputCols=[f"{c}_ohe" for c in cols])


def assemble(inputs: Sequence[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="keep")


@dataclass(frozen=True)
class FeatureStats:
    """What the features of one training set are built from: class counts, moments and category counts."""

    positives: int = 0
    negatives: int = 0
    skewness: Mapping[str, float | None] = field(default_factory=dict)
    mean: Mapping[str, float | None] = field(default_factory=dict)
    std: Mapping[str, float | None] = field(default_factory=dict)
    categories: Mapping[str, Mapping[str, int]] = field(default_factory=dict)

    def logs(self, cfg: FeatureConfig) -> SkewLog:
        """The candidates skewed beyond the threshold; a constant or empty column has no skewness and stays out."""
        chosen = tuple(c for c in cfg.log_candidates if self.skewness[c] is not None and abs(self.skewness[c]) > cfg.skew_threshold)
        return SkewLog(cfg.log_candidates, cfg.skew_threshold, chosen)

    def labels(self, col: str) -> list[str]:
        """Categories by index: most frequent first, ties by name."""
        counts = self.categories.get(col, {})
        return sorted(counts, key=lambda v: (-counts[v], v))


def _measured(cfg: FeatureConfig) -> dict[str, Column]:
    """Every number whose moments a feature table may need: numerics, candidates, and the candidates' logs."""
    plain = dict.fromkeys([*cfg.numeric, *cfg.log_candidates])
    return {c: F.col(c).cast("double") for c in plain} | {f"{c}_log": signed_log(F.col(c).cast("double")) for c in cfg.log_candidates}


def feature_statistics(train: DataFrame, cfg: FeatureConfig, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics of every group of ``by`` in one aggregate over one scan.

    A row becomes one record with all its numbers (``column`` is null) and one record per category column, so numbers and categories
    share the aggregate: map-side partial counts and central moments, one row per group and category after the shuffle. Moments are
    over known values. Columns: ``by``, ``column``, ``value``, ``n``, ``positives``, ``negatives``, and ``mean_*``, ``std_*`` and ``skew_*``.
    """
    numbers = _measured(cfg)
    kind = "struct<" + ", ".join(f"`{c}`: double" for c in numbers) + ">"
    text, none = F.lit(None).cast("string"), F.lit(None).cast(kind)
    records = [F.struct(text.alias("column"), text.alias("value"), F.struct(*[v.alias(c) for c, v in numbers.items()]).alias("x"))]
    records += [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), none.alias("x")) for c in cfg.categorical]
    long = train.select(*by, F.col(cfg.label).alias("_y"), F.explode(F.array(*records)).alias("_r"))
    moments = [f(F.col(f"_r.x.`{c}`")).alias(f"{name}_{c}") for c in numbers for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    moments += [F.skewness(F.col(f"_r.x.`{c}`")).alias(f"skew_{c}") for c in cfg.log_candidates]
    return long.groupBy(*by, F.col("_r.column").alias("column"), F.col("_r.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") == 1).alias("positives"), F.count_if(F.col("_y") == 0).alias("negatives"), *moments
    )


def read_statistics(stats: DataFrame, cfg: FeatureConfig, by: Sequence[str] = ()) -> dict[tuple, FeatureStats]:
    """The statistics by group; a row per group and category reaches the driver, as it does for any index of categories."""
    whole, counts = {}, defaultdict(lambda: defaultdict(dict))
    for r in stats.collect():
        group = tuple(r[c] for c in by)
        if r["column"] is None:
            whole[group] = r
        elif r["value"] is not None:
            counts[group][r["column"]][r["value"]] = r["n"]
    numbers = list(_measured(cfg))
    return {
        g: FeatureStats(
            r["positives"], r["negatives"], {c: r[f"skew_{c}"] for c in cfg.log_candidates}, {c: r[f"mean_{c}"] for c in numbers},
            {c: r[f"std_{c}"] for c in numbers}, {c: dict(v) for c, v in counts[g].items()},
        )
        for g, r in whole.items()
    }


def statistics_report(stats: DataFrame, cfg: FeatureConfig, by: Sequence[str] = ()) -> DataFrame:
    """Statistics as a long table: ``by``, ``column``, ``value``, ``n``, ``mean``, ``std``, ``skew`` and index ``idx`` of a category."""
    numbers, none = list(_measured(cfg)), F.lit(None).cast("double")
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), (F.col(f"skew_{c}") if c in cfg.log_candidates else none).alias("skew"))
        for c in numbers
    ]
    whole = stats.filter(F.col("column").isNull()).select(*by, "n", F.explode(F.array(*rows)).alias("_r"))
    whole = whole.select(*by, "_r.column", F.lit(None).cast("string").alias("value"), "n", "_r.mean", "_r.std", "_r.skew", F.lit(None).cast("int").alias("idx"))
    place = Window.partitionBy(*by, "column").orderBy(F.desc("n"), "value")  # one row per group and category
    index = (F.row_number().over(place) - 1).alias("idx")
    known = stats.filter(F.col("column").isNotNull() & F.col("value").isNotNull())
    return whole.unionByName(known.select(*by, "column", "value", "n", none.alias("mean"), none.alias("std"), none.alias("skew"), index))


def _scale_stage(cols: Sequence[str], stats: FeatureStats) -> Transformer:
    """Each number less its mean in units of its deviation as ``<col>_scaled``; a constant becomes 0."""

    def scaled(c: str) -> str:
        mean, std = stats.mean[c], stats.std[c]
        if mean is None or std is None:
            return f"CAST(NULL AS DOUBLE) AS `{c}_scaled`"
        return f"(CAST(`{c}` AS DOUBLE) - {mean!r}D) * {(1 / std if std else 0.0)!r}D AS `{c}_scaled`"

    return SQLTransformer(statement="SELECT *, " + ", ".join(map(scaled, cols)) + " FROM __THIS__")


def build_features(cfg: FeatureConfig, stats: FeatureStats, like: DataFrame) -> PipelineModel:
    """The fitted pipeline up to the three final vectors, built from statistics without reading rows.

    ``log_scaled_features`` and ``log_unscaled_features`` hold the numerics with skewed ones replaced by
    their logs, standardised or as they are; ``full_unscaled_features`` holds all numerics unlogged. Each
    is followed by the one-hot block and the flags; a category without a known training value has no part in it. ``like`` names the
    session and the types of the columns.
    """
    logs = stats.logs(cfg)
    numeric = sorted([c for c in cfg.numeric if c not in logs.chosen] + [c for c in logs.log_columns if c[:-4] in cfg.numeric])
    stages: list[Any] = [logs.stage(), _scale_stage(numeric, stats)]
    tail: list[str] = list(cfg.flags)
    cols = [c for c in cfg.categorical if stats.labels(c)]
    if cols:
        # One model per column: columns have lists of labels of different lengths.
        index = PipelineModel([index_model(c, stats.labels(c)) for c in cols])
        # The encoder takes its sizes from the index columns' metadata: no row is needed.
        empty = like.sparkSession.createDataFrame([], like.select(*cols).schema)
        stages += [*index.stages, one_hot_stage(cols).fit(index.transform(empty)), assemble([f"{c}_ohe" for c in cols], "ohe_vector")]
        tail = ["ohe_vector", *tail]
    return PipelineModel(
        stages
        + [
            assemble(numeric, "num_vector"),
            assemble([f"{c}_scaled" for c in numeric], "scaled_num_vector"),
            assemble(["scaled_num_vector", *tail], "log_scaled_features"),
            assemble(["num_vector", *tail], "log_unscaled_features"),
            assemble([*sorted(cfg.numeric), *tail], "full_unscaled_features"),
        ]
    )


def apply_features(cfg: FeatureConfig, model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(flags_to_double(df, cfg.flags))


def fit_features(cfg: FeatureConfig, train: DataFrame) -> PipelineModel:
    """Everything learnt from training rows only, in one pass: skewness, categories, means and deviations."""
    return build_features(cfg, read_statistics(feature_statistics(train, cfg), cfg).get((), _no_rows(cfg)), train)


def _no_rows(cfg: FeatureConfig) -> FeatureStats:
    unknown = dict.fromkeys(_measured(cfg))
    return FeatureStats(0, 0, unknown, unknown, unknown)


def fit_apply_groups(
    cfg: FeatureConfig,
    table: DataFrame,
    by: Sequence[str],
    groups: Sequence[tuple],
    role: str,
    balance_key: str | Sequence[str] | None = None,
    train: str = "train",
) -> dict[tuple, tuple[PipelineModel, FeatureStats, DataFrame, DataFrame]]:
    """Features of many training sets of one table: model, statistics, training rows and other rows of each group.

    ``role`` tells training rows from others. All statistics come from one aggregate over one scan of the training rows; the class counts
    among them balance the training rows *after* the fit, by a filter, if a key is given.
    """
    learnt = read_statistics(feature_statistics(table.filter(F.col(role) == train), cfg, by), cfg, by)
    out = {}
    for group in groups:
        rows = table
        for c, v in zip(by, group, strict=True):
            rows = rows.filter(F.col(c) == v)
        stats = learnt.get(tuple(group), _no_rows(cfg))
        model = build_features(cfg, stats, table)
        fitted = apply_features(cfg, model, rows.filter(F.col(role) == train))
        if balance_key is not None:
            fitted = keep_balanced(fitted, cfg.label, balance_key, stats.positives, stats.negatives)
        out[tuple(group)] = (model, stats, fitted, apply_features(cfg, model, rows.filter(F.col(role) != train)))
    return out


def fit_apply(
    cfg: FeatureConfig,
    train: DataFrame,
    others: Mapping[str, DataFrame],
    balance_key: str | Sequence[str] | None = None,
) -> tuple[PipelineModel, DataFrame, dict[str, DataFrame]]:
    """Fit on train in one pass, transform train and the other tables; balance train *after* fitting if a key is given."""
    stats = read_statistics(feature_statistics(train, cfg), cfg).get((), _no_rows(cfg))
    model = build_features(cfg, stats, train)
    out = apply_features(cfg, model, train)
    if balance_key is not None:
        out = keep_balanced(out, cfg.label, balance_key, stats.positives, stats.negatives)
    return model, out, {n: apply_features(cfg, model, df) for n, df in others.items()}


def per_column_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Standardised numerics and indexed categories for a flat export.

    Scaling is per column anyway, so one vector of all numerics is scaled in a single pass over the
    data instead of one fit per column.
    """
    return Pipeline(
        stages=[
            assemble(numeric, "_numeric"),
            StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
            index_stage(categorical, "_idx2"),
        ]
    )


def cardinalities(model: PipelineModel, fixed: Mapping[str, int] | None = None) -> dict[str, int]:
    """Number of index values per category (with the bucket for unseen ones), some of them imposed."""
    found: dict[str, int] = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            cols = stage.getInputCols()
            found |= {c: len(labels) + 1 for c, labels in zip(cols, stage.labelsArray, strict=True)}
    return found | {c: n for c, n in (fixed or {}).items() if c in found}


def flat_export(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    flags: Sequence[str],
    label: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Plain numeric columns for training outside Spark: ``_num`` double, ``_cat`` int, ``_bin`` float, ``target``.

    ``keep`` names columns, such as ids, to pass through.
    """
    scaled = vector_to_array("_scaled")
    return df.select(
        *keep,
        *[F.get(scaled, F.lit(i)).alias(f"{c}_num") for i, c in enumerate(numeric)],
        *[F.col(f"{c}_idx2").cast("int").alias(f"{c}_cat") for c in categorical],
        *[F.col(c).cast("float").alias(f"{c}_bin") for c in flags],
        F.col(label).cast("float").alias("target"),
    )


def vector_slot(col: str, slot: int | Column) -> Column:
    """One slot of a vector column, null beyond its end. The zeros of a sparse vector are never laid out, so a row costs what it holds, not its size."""
    v, at = F.unwrap_udt(col), (F.lit(slot) if isinstance(slot, int) else slot).cast("int")
    held = F.get(v["values"], (F.array_position(v["indices"], at) - 1).cast("int"))
    return F.when(v["type"] == 1, F.get(v["values"], at)).when((at >= 0) & (at < v["size"]), F.coalesce(held, F.lit(0.0)))


def vector_size(col: str) -> Column:
    """Number of slots of a vector column, read off without laying out its zeros."""
    v = F.unwrap_udt(col)
    return F.when(v["type"] == 1, F.size(v["values"])).otherwise(v["size"])


def vector_slots(df: DataFrame, col: str) -> list[tuple[int, str]]:
    """(index, name) of every slot of a vector column, from its metadata."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = [(a["idx"], a.get("name", str(a["idx"]))) for group in attrs.values() for a in group]
    return sorted(slots)


def slot_names(slots: Sequence[tuple[int, str]], wanted: Sequence[int]) -> dict[int, str]:
    """Names of the wanted slot indices; indices out of range are left out."""
    names = dict(slots)
    return {i: names[i] for i in wanted if i in names}


def hash_stage(cols: Sequence[str], output: str, size: int = 1 << 10) -> FeatureHasher:
    """Hashed vector of high-cardinality ids; no dictionary has to be learnt or kept."""
    return FeatureHasher(inputCols=list(cols), outputCol=output, numFeatures=size, categoricalCols=list(cols))


def select_by_share(importance: DataFrame, limit: float, measure: str = "importance", name: str = "feature") -> DataFrame:
    """The most important features whose running share, before adding the feature, is below the limit (percent)."""
    ranked = cumulative_share(importance, measure, name)
    return ranked.filter(F.col("cumulative_share") - F.col("share") < limit)


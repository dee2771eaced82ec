"""Profiles and audits of whole tables, each in one pass over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.operators.reports import count_violations


def _long(one_row: DataFrame, cols: Sequence[str], keep: Sequence[str], name: str, value: str) -> DataFrame:
    return one_row.unpivot(list(keep), list(cols), name, value)


def wide_to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """Columns turned into rows; the listed columns must share a type."""
    return df.unpivot(list(ids), list(cols), name, value)


def simple_type(kind: T.DataType) -> str:
    """Short readable name of a column type."""
    if isinstance(kind, T.ArrayType):
        inner = {T.StructType: "Struct", T.StringType: "String", T.IntegerType: "Integer"}.get(type(kind.elementType))
        return f"Array[{inner}]" if inner else "Array"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "Double"
    return type(kind).__name__.removesuffix("Type")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, null count and null percentage per column: one aggregate, then a one-row unpivot."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows"))
    names = {x: simple_type(df.schema[x].dataType) for x in cols}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return _long(counts, cols, ["_rows"], "column_name", "null_count").select(
        "column_name",
        F.element_at(F.create_map(*pairs), F.col("column_name")).alias("data_type"),
        "null_count",
        (F.col("null_count") / F.nullif(F.col("_rows"), F.lit(0)) * 100).alias("null_percent"),
    )


def nulls_by_type(df: DataFrame) -> DataFrame:
    """Null counts rolled up by column type."""
    return null_profile(df).groupBy("data_type").agg(
        F.sum("null_count").alias("total_null_count"),
        F.count(F.lit(1)).alias("num_columns"),
        F.sum("null_percent").alias("null_percent"),
    )


def distinct_counts(df: DataFrame, cols: Sequence[str], limit: int | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct values per column, exact by default or as sketches with a relative deviation, and
    whether each exceeds a limit."""
    one = [F.approx_count_distinct(c, rsd) if rsd else F.count_distinct(F.col(c)) for c in cols]
    row = df.agg(*[x.alias(c) for x, c in zip(one, cols, strict=True)])
    out = _long(row, cols, [], "column_name", "n_distinct")
    return out if limit is None else out.withColumn("over_limit", F.col("n_distinct") > limit)


def distinct_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """A sketch of the distinct values of every column per group, to keep: a few kilobytes each, whatever the rows.

    Kept per day or fold they are merged for any union of groups by ``merged_distinct`` without reading rows again. The relative standard error
    is about ``0.8 / sqrt(2 ** lg_k)`` (1.3 % for 12); nulls are not counted.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(c) for c in cols])


def merged_distinct(sketches: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values per group of ``by`` from kept sketches."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and duplicates of the whole table."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.sum("_n").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def skew_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness per column; null for constant and empty columns."""
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in cols])
    return _long(row, cols, [], "column_name", "skewness").withColumn("skewness", F.nanvl("skewness", F.lit(None)))


def low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Columns whose standard deviation does not exceed the threshold."""
    row = df.agg(*[F.stddev(F.col(c).cast("double")).alias(c) for c in cols])
    return _long(row, cols, [], "column_name", "stddev").filter(F.col("stddev") <= threshold)


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Matrix of Pearson correlations, each over the rows where both columns are known; NaN where one does not vary.

    A row becomes a vector of its values less their means (0 where unknown), their squares, and whether they are known. The Gram matrix of these, one
    aggregate of one vector per row whatever the number of pairs, holds every pair's count, sums, sums of squares and cross products.
    """
    k = len(cols)
    total, *means = df.agg(F.count(F.lit(1)), *[F.avg(F.col(c).cast("double")) for c in cols]).first()
    if not total:
        return np.full((k, k), np.nan)
    x = [F.coalesce(F.col(c).cast("double") - F.lit(m or 0.0), F.lit(0.0)) for c, m in zip(cols, means, strict=True)]
    known = [F.col(c).isNotNull().cast("double") for c in cols]
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*x, *[v * v for v in x], *known)).alias("v")), "v")
    gram = RowMatrix(rows, numCols=3 * k).computeGramianMatrix().toArray()
    n, sx, sxx, sxy = gram[2 * k :, 2 * k :], gram[:k, 2 * k :], gram[k : 2 * k, 2 * k :], gram[:k, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        spread = np.where(spread > 1e-12 * sxx, spread, 0.0)
        return (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)


def correlations(df: DataFrame, cols: Sequence[str], label: str | None = None, threshold: float | None = None) -> DataFrame:
    """Pearson correlation of each column with the label, or of all column pairs, over all rows.

    With a threshold only pairs with a larger absolute value stay; a pair of which one column does not vary has none.
    """
    if label:
        pairs = [(c, label) for c in cols]
        row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
        found = [(a, b, v) for (a, b), v in zip(pairs, row, strict=True)]
    else:
        matrix = pairwise_correlations(df, cols)
        found = [(a, b, float(matrix[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    found = [(a, b, None if v is None or v != v else v) for a, b, v in found]
    out = df.sparkSession.createDataFrame(found, "column_a string, column_b string, correlation double")
    return out if threshold is None else out.filter(F.abs("correlation") > threshold)


def flag_balance(df: DataFrame, cols: Sequence[str], rare: float = 0.01) -> DataFrame:
    """Share of the rarer value of each 0/1 flag, and whether it is below ``rare``."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    out = _long(row, cols, [], "column_name", "positive_share")
    minority = F.least(F.col("positive_share"), 1 - F.col("positive_share"))
    return out.withColumns({"minority_share": minority, "is_rare": minority < rare})


def leakage_audit(df: DataFrame, gap: str, limit: float, features: Sequence[str]) -> DataFrame:
    """Per feature, rows whose gap is below the limit although the feature is known; also the rows at risk."""
    return count_violations(df, leakage_rules(gap, limit, features))


def leakage_rules(gap: str, limit: float, features: Sequence[str]) -> dict[str, Column]:
    """What ``leakage_audit`` counts, by name."""
    risky = F.col(gap) < limit
    return {f"{f}_violations": risky & F.col(f).isNotNull() for f in features} | {"risk_rows": risky}


def null_metrics(df: DataFrame) -> dict[str, Column]:
    """Null count of every column, as aggregates."""
    return {f"nulls_{c}": F.count_if(F.col(c).isNull()) for c in df.columns}


def require_no_leakage(df: DataFrame, gap: str, limit: float, features: Sequence[str]) -> DataFrame:
    """The frame unchanged, or an error naming the features that leak."""
    refuse_leakage(leakage_audit(df, gap, limit, features).first().asDict(), features)
    return df


def refuse_leakage(row: Mapping[str, int], features: Sequence[str]) -> None:
    """An error if an audit's counts name features that leak."""
    bad = {f: row[f"{f}_violations"] for f in features if row[f"{f}_violations"]}
    if bad:
        raise ValueError(f"features known before the prediction time limit: {bad}")


def split_coverage(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    """First and last time, size and share of each side of a split."""
    per = df.groupBy(split).agg(
        F.min(ts).alias("min_time"), F.max(ts).alias("max_time"), F.count(F.lit(1)).alias("n_rows")
    )
    total = per.agg(F.sum("n_rows")).scalar()
    return per.withColumn("row_share", F.col("n_rows") / total)


def align_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """For every column of any table, the tables that lack it (empty list when aligned)."""
    every = sorted(reduce(lambda a, b: a | b, [set(t.columns) for t in tables.values()]))
    spark = next(iter(tables.values())).sparkSession
    rows = [(c, [n for n, t in tables.items() if c not in t.columns]) for c in every]
    return spark.createDataFrame(rows, "column_name string, missing_in array<string>")

"""Hold-outs, rolling-origin folds, class balancing and sampling."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.config import FOLD_MONTHS, HOLDOUT_MONTHS
from skyfold.operators.ordered import global_rank
from skyfold.session import stored


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day some months later, or that month's last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class Holdout:
    """Half-open ranges: training ``[train_start, test_start)``, test ``[test_start, test_end)``."""

    train_start: dt.date
    test_start: dt.date
    test_end: dt.date


@dataclass(frozen=True)
class Fold:
    """Half-open ranges: training ``[train_start, val_start)``, validation ``[val_start, val_end)``."""

    number: int
    train_start: dt.date
    val_start: dt.date
    val_end: dt.date


@dataclass(frozen=True)
class FoldSpec:
    """Months of training, validation and step."""

    train: int
    val: int
    step: int


def holdout(start: dt.date, train_months: int, test_months: int) -> Holdout:
    return Holdout(start, add_months(start, train_months), add_months(start, train_months + test_months))


def holdout_for(size: int | str, start: dt.date) -> Holdout:
    """Hold-out of one of the supported data set sizes."""
    return holdout(start, *HOLDOUT_MONTHS[size])


def fold_spec_for(size: int | str) -> FoldSpec:
    return FoldSpec(*FOLD_MONTHS[size])


def _within(ts: Column, start: dt.date, end: dt.date) -> Column:
    return (ts >= F.lit(start)) & (ts < F.lit(end))


def apply_holdout(df: DataFrame, ts: str, bounds: Holdout, split: str = "split") -> DataFrame:
    """Rows of either side with a ``split`` column; rows outside both or without a time drop out.

    The outer range is a plain filter, so it reaches the scan.
    """
    inside = df.filter(_within(F.col(ts), bounds.train_start, bounds.test_end))
    return inside.withColumn(split, F.when(F.col(ts) < F.lit(bounds.test_start), "train").otherwise("test"))


def rolling_folds(start: dt.date, last_day: dt.date, spec: FoldSpec) -> list[Fold]:
    """Folds whose validation ends at most one day after ``last_day``."""
    folds: list[Fold] = []
    val_start = add_months(start, spec.train)
    limit = last_day + dt.timedelta(1)
    while (val_end := add_months(val_start, spec.val)) <= limit:
        folds.append(Fold(len(folds) + 1, add_months(val_start, -spec.train), val_start, val_end))
        val_start = add_months(val_start, spec.step)
    return folds


def assign_folds(df: DataFrame, ts: str, folds: Sequence[Fold]) -> DataFrame:
    """Every row once per fold and role it belongs to, as one long table (``fold``, ``role``).

    The boundaries are a short constant array, filtered and exploded per row: no join and no shuffle.
    Written partitioned by fold and role this replaces a directory per fold and side.
    """
    if not folds:
        return df.withColumns({"fold": F.lit(None).cast("int"), "role": F.lit(None).cast("string")}).limit(0)
    t = F.col(ts)
    roles = [
        F.when(_within(t, a, b), F.struct(F.lit(f.number).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, a, b in (("train", f.train_start, f.val_start), ("val", f.val_start, f.val_end))
    ]
    reach = _within(t, min(f.train_start for f in folds), max(f.val_end for f in folds))
    hits = df.filter(reach).withColumn("_role", F.explode(F.array_compact(F.array(*roles))))
    return hits.withColumns({"fold": F.col("_role.fold"), "role": F.col("_role.role")}).drop("_role")


def fold_bounds(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """The fold boundaries as a small table."""
    rows = [(f.number, f.train_start, f.val_start, f.val_end) for f in folds]
    return df.sparkSession.createDataFrame(rows, "fold int, train_start date, val_start date, val_end date")


def day_range(df: DataFrame, ts: str) -> tuple[dt.date, dt.date]:
    """First and last day of a table."""
    row = df.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
    return row[0], row[1]


def hash_share(*keys: str) -> Column:
    """A repeatable number in [0, 1) per key, independent of partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_sample(df: DataFrame, key: str | Sequence[str], fraction: float) -> DataFrame:
    """About ``fraction`` of the rows, the same ones in every run."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.filter(hash_share(*keys) < fraction)


def downsample(df: DataFrame, label: str, key: str | Sequence[str], target_ratio: float = 1.0) -> DataFrame:
    """All positives and a repeatable sample of the negatives, ``target_ratio`` positives to each negative.

    One aggregate finds the share to keep; then a single filter does the work, with no split, no union
    and no shuffle. Unchanged when the negatives are not in the majority at that ratio.
    """
    pos, neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return keep_balanced(df, label, key, pos, neg, target_ratio)


def keep_balanced(df: DataFrame, label: str, key: str | Sequence[str], pos: int, neg: int, target_ratio: float = 1.0) -> DataFrame:
    """``downsample`` for rows whose class counts are known already."""
    keys = [key] if isinstance(key, str) else list(key)
    if neg == 0 or pos / neg / target_ratio >= 1.0:
        return df
    keep = pos / neg / target_ratio
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (hash_share(*keys) < keep)))


def add_class_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Weight ``rows / (classes * rows of the class)`` per row, joined from the class counts.

    The counts have a row per class; adaptive execution broadcasts them when they are small and splits hot classes when not.
    """
    counts = stored(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n")), "class_counts")
    total, classes = counts.agg(F.sum("_n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    table = counts.select(
        F.col(label_col).alias("_label"), (total / (classes * F.col("_n"))).cast("double").alias(weight_col)
    )
    return df.join(table, df[label_col].eqNullSafe(table["_label"])).drop("_label")


def ratio_split(df: DataFrame, order: str, tie: str, shares: Sequence[float], names: Sequence[str], split: str = "split") -> DataFrame:
    """Earliest ``shares[0]`` of the rows, the next ``shares[1]``, ..., and the rest under the last name."""
    ranked = global_rank(df, order, tie, "_rank")
    total = df.agg(F.count(F.lit(1))).scalar()
    bound, chain = F.lit(0), F
    for share, name in zip(shares, names, strict=False):
        bound = bound + F.floor(total * share)
        chain = chain.when(F.col("_rank") <= bound, F.lit(name))
    return ranked.withColumn(split, chain.otherwise(F.lit(names[-1]))).drop("_rank")


def year_split(df: DataFrame, date_col: str, roles: dict[str, tuple[int, int]], split: str = "split") -> DataFrame:
    """Split by inclusive year ranges; other years drop out."""
    year, chain = F.year(date_col), F
    for name, (lo, hi) in roles.items():
        chain = chain.when(year.between(lo, hi), F.lit(name))
    return df.withColumn(split, chain).filter(F.col(split).isNotNull())

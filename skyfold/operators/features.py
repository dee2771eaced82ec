"""Row features: leakage-safe previous-leg features, missing values, label repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.functions.clock import epoch_seconds
from skyfold.operators.ordered import ROWS_PER_SEGMENT, previous_event
from skyfold.operators.quality import null_metrics, null_profile
from skyfold.operators.reports import median


def previous_leg_features(
    df: DataFrame,
    *,
    key: str,
    sched_dep: str,
    sched_arr: str,
    arr: str,
    arr_delay: str,
    tie: str,
    gap_seconds: int = 3661,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """What is known about the same vehicle's previous leg ``gap_seconds`` before the scheduled departure.

    Adds the previous delay (only if that leg had arrived by then and was not early), the planned
    turnaround in minutes, the actual turnaround (only if arrived by then), the previous scheduled
    arrival, and the hours between the previous arrival and this departure as ``leakage``.
    """
    prev = {arr_delay: "_prev_delay", arr: "_prev_arr", sched_arr: "prev_crs_arr_time_utc"}
    out = previous_event(df, key, sched_dep, prev, tie, rows_per_segment)
    dep, was = epoch_seconds(sched_dep), epoch_seconds("_prev_arr")
    arrived = was < dep - gap_seconds
    return out.withColumns(
        {
            "prev_flight_arr_delay_clean": F.when(arrived & (F.col("_prev_delay") >= 0), F.col("_prev_delay")),
            "crs_time_to_next_flight_diff_mins": (dep - epoch_seconds("prev_crs_arr_time_utc")) / 60,
            "actual_to_crs_time_to_next_flight_diff_mins_clean": F.when(arrived, (dep - was) / 60),
            "leakage": (dep - was) / 3600,
        }
    ).drop("_prev_delay", "_prev_arr")


@dataclass(frozen=True)
class FillPolicy:
    """Fitted replacements of missing values: fit on training rows, then apply anywhere."""

    values: Mapping[str, float]

    def covered(self, df: DataFrame) -> list[str]:
        """Columns of ``df`` whose nulls the policy replaces; a number does not fill a text column."""
        kinds = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema.fields}
        return [c for c, v in self.values.items() if v is not None and kinds.get(c) == isinstance(v, str)]

    def apply(self, df: DataFrame) -> DataFrame:
        present = {c: self.values[c] for c in self.covered(df)}
        return df.fillna(present) if present else df


def fit_fill(
    df: DataFrame,
    zero: Sequence[str] = (),
    medians: Sequence[str] = (),
    constants: Mapping[str, float] | None = None,
    accuracy: int | None = 100,
    observed: Mapping[str, Any] | None = None,
) -> FillPolicy:
    """Zeros, medians (read from ``df``, or as ``observed`` already) and constants by column; absent columns are skipped."""
    known = observed or {}
    values: dict[str, float] = {c: 0 for c in zero if c in df.columns}
    values |= {c: known[f"median_{c}"] if f"median_{c}" in known else median(df, c, accuracy) for c in medians if c in df.columns}
    values |= {c: v for c, v in (constants or {}).items() if c in df.columns}
    return FillPolicy(values)


def cleaning_metrics(df: DataFrame, medians: Sequence[str], accuracy: int | None = 100) -> dict[str, Column]:
    """What ``clean_nulls`` must know of a table, as aggregates; exact medians are not among them."""
    middle = {c: F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy) for c in medians if c in df.columns and accuracy is not None}
    return null_metrics(df) | {f"median_{c}": v for c, v in middle.items()}


def clean_nulls(
    df: DataFrame,
    zero: Sequence[str],
    medians: Sequence[str],
    constants: Mapping[str, float],
    expected: Sequence[str] = (),
    accuracy: int | None = 100,
    observed: Mapping[str, Any] | None = None,
) -> tuple[DataFrame, list[str], DataFrame]:
    """Filled frame, columns still holding nulls, and a report of nulls per column before and after.

    The report also says whether nulls were expected in the column; expected columns that the frame lacks are listed without counts. One pass counts the nulls, or
    none if ``observed`` has them already (``cleaning_metrics``); what a fill leaves over follows from it.
    """
    policy = fit_fill(df, zero, medians, constants, accuracy, observed)
    if observed is None:
        counts = [(r["column_name"], r["null_count"]) for r in null_profile(df).collect()]
    else:
        counts = [(c, observed[f"nulls_{c}"]) for c in df.columns]
    covered, wanted = set(policy.covered(df)), set(expected)
    rows = [(c, n, 0 if c in covered else n, c in wanted) for c, n in counts]
    absent = [c for c in expected if c not in df.columns]  # expected, but not there: no counts
    rows += [(c, None, None, True) for c in absent]
    report = df.sparkSession.createDataFrame(
        rows, "column_name string, nulls_before bigint, nulls_after bigint, expected boolean"
    )
    return policy.apply(df), sorted(c for c, _, after, _ in rows if after), report


def repair_label(df: DataFrame, label: str, actual: str, planned: str, limit: float = 15) -> DataFrame:
    """Missing labels set to 1 when the actual time exceeds the planned one by the limit, else to 0."""
    late = (F.col(actual) - F.col(planned)) >= limit
    return df.withColumn(label, F.coalesce(F.col(label), F.when(late, F.lit(1)).otherwise(F.lit(0))))


def flags_to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0/1 flags as doubles, missing ones as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})

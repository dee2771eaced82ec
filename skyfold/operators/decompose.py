"""Seasonal decomposition of many series at once by centred moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decompose(df: DataFrame, series: str, date_col: str, value: str, period: int) -> DataFrame:
    """Observed value = trend + seasonal + residual for each series.

    ``df`` has one row per series and date. The trend is the mean over one period centred on the row (for an even period
    the two end rows count half), null near the ends where the period is not complete. The seasonal
    part is the mean detrended value of each phase (row number modulo period), shifted to sum to 0.

    Series are independent windows over rows that are already one per date, so a window's size is the
    number of dates, whatever the number of underlying facts.
    """
    by_date = W.partitionBy(series).orderBy(date_col)
    half = period // 2
    full = by_date.rowsBetween(-half, half)
    v = F.col(value)
    if period % 2:
        trend = F.avg(v).over(full)
    else:
        inner = F.sum(v).over(by_date.rowsBetween(-half + 1, half - 1))
        trend = (inner + (F.lag(v, half).over(by_date) + F.lead(v, half).over(by_date)) / 2) / period
    complete = F.count(v).over(full) == 2 * half + 1
    phased = df.withColumns(
        {
            "phase": F.pmod(F.row_number().over(by_date) - 1, F.lit(period)).cast("int"),
            "trend": F.when(complete, trend),
        }
    ).withColumn("_detrended", v - F.col("trend"))
    per_phase = F.avg("_detrended").over(W.partitionBy(series, "phase"))
    parts = phased.withColumn("_phase_mean", per_phase)
    first_of_phase = F.row_number().over(W.partitionBy(series, "phase").orderBy(date_col)) == 1
    level = F.avg(F.when(F.col("_first"), F.col("_phase_mean"))).over(W.partitionBy(series))
    return (
        parts.withColumn("_first", first_of_phase)
        .withColumn("seasonal", F.col("_phase_mean") - level)
        .withColumn("residual", v - F.col("trend") - F.col("seasonal"))
        .drop("_detrended", "_phase_mean", "_first")
    )

"""Grouped reports: rates, counts, matrices, histograms, contingency tables, calendar series.

All of them aggregate map-side first, so a hot group reaches the shuffle as one row per task.
Reports are small tables; whatever they join or rank afterwards is no longer sized by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.operators.ordered import exact_quantiles
from skyfold.session import stored


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def rate(part: Column, whole: Column) -> Column:
    """Percent, null when the whole is 0."""
    return part / F.nullif(whole, F.lit(0)) * 100


def rate_by(
    df: DataFrame,
    keys: str | Sequence[str],
    flag: str,
    *,
    min_total: int | None = None,
    total: str = "total",
    flagged: str = "flagged",
    rate_col: str = "rate",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows, flagged rows and their percentage per group, with further aggregates alongside if wanted."""
    out = df.groupBy(*_keys(keys)).agg(
        F.count(F.lit(1)).alias(total),
        F.sum(F.col(flag).cast("int")).alias(flagged),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    out = out.withColumn(rate_col, rate(F.col(flagged), F.col(total)))
    return out if min_total is None else out.filter(F.col(total) >= min_total)


def rate_cube(df: DataFrame, sets: Sequence[Sequence[str]], flag: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Additive partials of many reports from one scan: rows, known flags, flagged rows and further sums per grouping set, written once.

    Every set's groups are combined map-side, so the shuffle carries report rows only. ``rates_from`` and ``means_from`` read
    what ``rate_by`` and ``mean_flag_by`` would give for a set, without the table.
    """
    dims = list(dict.fromkeys(c for keys in sets for c in keys))
    found = df.groupingSets([[F.col(c) for c in keys] for keys in sets], *[F.col(c) for c in dims]).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(flag).alias("_known"),
        F.sum(F.col(flag).cast("int")).alias("_flagged"),
        *[F.sum(c).alias(n) for n, c in (sums or {}).items()],
    )
    return stored(found.select(*dims, *[c for c in found.columns if c not in dims]), "cube")


def _of_set(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    dims = cube.columns[: cube.columns.index("_set")]
    wanted = sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in keys)
    return cube.filter(F.col("_set") == wanted)


def rates_from(
    cube: DataFrame, keys: str | Sequence[str], *, min_total: int | None = None, total: str = "total", flagged: str = "flagged", rate_col: str = "rate",
    sums: Sequence[str] = (),
) -> DataFrame:
    """The report ``rate_by`` gives for ``keys``, from a cube that has them as a set."""
    rows = _of_set(cube, _keys(keys)).select(
        *_keys(keys), F.col("_rows").alias(total), F.col("_flagged").alias(flagged), *sums, rate(F.col("_flagged"), F.col("_rows")).alias(rate_col)
    )
    return rows if min_total is None else rows.filter(F.col(total) >= min_total)


def means_from(cube: DataFrame, keys: str | Sequence[str], alias: str = "pct_flagged") -> DataFrame:
    """The report ``mean_flag_by`` gives for ``keys``."""
    return _of_set(cube, _keys(keys)).select(*_keys(keys), (F.col("_flagged") / F.nullif(F.col("_known"), F.lit(0))).alias(alias))


def count_by(df: DataFrame, keys: str | Sequence[str], alias: str = "n") -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(alias))


def mean_by(df: DataFrame, keys: str | Sequence[str], means: Mapping[str, str]) -> DataFrame:
    """Mean of columns per group; of a 0/1 flag this is its rate."""
    return df.groupBy(*_keys(keys)).agg(*[F.avg(c).alias(n) for c, n in means.items()])


def mean_flag_by(df: DataFrame, keys: str | Sequence[str], flag: str, alias: str = "pct_flagged") -> DataFrame:
    return mean_by(df, keys, {flag: alias})


def avg_where(value: str, pred: Column) -> Column:
    """Mean over the rows that satisfy the predicate."""
    return F.avg(F.when(pred, F.col(value)))


def min_max(df: DataFrame, col: str, lo: str = "min_value", hi: str = "max_value") -> DataFrame:
    return df.agg(F.min(col).alias(lo), F.max(col).alias(hi))


def compare_datasets(df: DataFrame, datasets: Mapping[str, Column], flag: str, date_col: str) -> DataFrame:
    """Size, class balance and period of several parts of a table, each given by a condition, in one pass."""

    def part(name: str, own: Column) -> Column:
        return F.struct(
            F.count_if(own & (F.col(flag) == 0)).alias("class_0_count"),
            F.count_if(own & (F.col(flag) == 1)).alias("class_1_count"),
            F.count_if(own).alias("total_rows"),
            F.min(F.when(own, F.col(date_col))).alias("start_date"),
            F.max(F.when(own, F.col(date_col))).alias("end_date"),
            F.lit(name).alias("dataset_name"),
        )

    one = df.agg(F.array(*[part(n, c) for n, c in datasets.items()]).alias("parts"))
    return one.select(F.inline("parts")).withColumn("class_1_pct", F.round(rate(F.col("class_1_count"), F.col("total_rows")), 2))


def rate_matrix(
    df: DataFrame, row: str, col: str, values: Sequence[Any], flag: str, fill: float | None = -1.0,
    prefix: str = "",
) -> DataFrame:
    """Percentage of flagged rows with groups as rows and the listed values as columns.

    The value list is stated, so no extra job has to find it, and rows with other values are dropped
    before the shuffle.
    """
    wanted = df.filter(F.col(col).isin(list(values)))
    cell = rate(F.sum(F.col(flag).cast("int")), F.count(F.lit(1)))
    out = wanted.groupBy(row).pivot(col, list(values)).agg(cell)
    out = out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values} if prefix else {})
    return out if fill is None else out.fillna(fill)


def busiest(df: DataFrame, key: str, k: int) -> list:
    """The k most frequent keys, most frequent first (k values on the driver)."""
    top = count_by(df, key).orderBy(F.col("n").desc(), F.col(key)).limit(k)
    return [r[0] for r in top.select(key).collect()]


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 table of two 0/1 flags with cohort percentages, in one aggregate.

    ``persistent`` and ``recovered`` split the rows with ``a`` set, ``new`` and ``clear`` those without.
    """
    fa, fb = F.col(a), F.col(b)
    known = df.filter(fa.isNotNull() & fb.isNotNull())
    cells = known.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((fa == 1) & (fb == 1)).alias("persistent"),
        F.count_if((fa == 1) & (fb == 0)).alias("recovered"),
        F.count_if((fa == 0) & (fb == 1)).alias("new"),
        F.count_if((fa == 0) & (fb == 0)).alias("clear"),
    ).withColumns({"a_set": F.col("persistent") + F.col("recovered"), "a_unset": F.col("new") + F.col("clear")})
    pct = {
        "a_set_pct": rate(F.col("a_set"), F.col("total")),
        "a_unset_pct": rate(F.col("a_unset"), F.col("total")),
        "persistent_pct": rate(F.col("persistent"), F.col("a_set")),
        "recovered_pct": rate(F.col("recovered"), F.col("a_set")),
        "new_pct": rate(F.col("new"), F.col("a_unset")),
        "clear_pct": rate(F.col("clear"), F.col("a_unset")),
    }
    return cells.withColumns(pct)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over the column's range; the maximum belongs to the last bin.

    The range is a scalar sub-query, so the data is scanned lazily and nothing but bins is shuffled.
    """
    known = df.filter(F.col(col).isNotNull())
    lo = known.agg(F.min(col)).scalar()
    hi = known.agg(F.max(col)).scalar()
    width = (hi - lo) / bins
    place = F.coalesce(F.floor((F.col(col) - lo) / F.nullif(width, F.lit(0.0))), F.lit(0))
    counts = count_by(known.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")), "bin")
    return counts.withColumns({"bin_from": lo + F.col("bin") * width, "bin_to": lo + (F.col("bin") + 1) * width})


def flag_extremes(df: DataFrame, col: str, lo: float | None, hi: float, strict: bool = False) -> DataFrame:
    """Marks values at or beyond the lower and upper quantile (beyond only, when ``strict``)."""
    probs = ([lo] if lo is not None else []) + [hi]
    found = exact_quantiles(df, col, probs)
    if not found:
        return df.withColumn("is_extreme", F.lit(False))
    c = F.col(col)
    test = c > found[-1] if strict else c >= found[-1]
    if lo is not None:
        test = test | (c < found[0] if strict else c <= found[0])
    return df.withColumn("is_extreme", test)


def median(df: DataFrame, col: str, accuracy: int | None = 100) -> float | None:
    """Median of a column: within ``1 / accuracy`` of its rank, or exact and interpolated with None."""
    if accuracy is None:
        found = exact_quantiles(df, col, [0.5])
        return found[0] if found else None
    return df.agg(F.percentile_approx(F.col(col).cast("double"), 0.5, accuracy)).first()[0]


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label, ties to the smaller one."""
    counts = count_by(df.filter(F.col(label).isNotNull()), label)
    best = counts.agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("_m"))
    return best.select("_m.*")


def summarise_report(report: DataFrame, keys: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Second-level aggregate over a report."""
    return report.groupBy(*_keys(keys)).agg(*[c.alias(n) for n, c in aggs.items()])


def resample(df: DataFrame, date_col: str, unit: str, value: str, alias: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Calendar resample to the mean per unit, per series when ``by`` names one."""
    period = F.trunc(date_col, unit).alias("period")
    return df.groupBy(*by, period).agg(F.avg(value).alias(alias or value))


def node_summary(df: DataFrame, key: str, score: str, coords: Sequence[str], order: str, score_alias: str = "score") -> DataFrame:
    """Mean score and first-seen attributes (first by ``order``) per key."""
    first = F.min_by(F.struct(*coords), F.col(order))
    out = df.groupBy(key).agg(F.avg(score).alias(score_alias), first.alias("_f"))
    return out.select(key, score_alias, *[F.col("_f")[c].alias(c) for c in coords])


def mean_metrics(runs: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of run metrics per hyper-parameter set."""
    return runs.groupBy(*params).agg(*[F.avg(m).alias(m) for m in metrics])


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass, with the number of rows checked."""
    return df.agg(*[F.count_if(rule).alias(n) for n, rule in rules.items()], F.count(F.lit(1)).alias("total_rows"))


def curved_path(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, points: int = 100) -> DataFrame:
    """Each route as ``points`` positions on a straight line lifted by a sine arc of height 2."""
    t = F.col("step") / F.lit(float(points - 1))
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumns(
        {
            "lon": F.col(lon1) + (F.col(lon2) - F.col(lon1)) * t,
            "lat": F.col(lat1) + (F.col(lat2) - F.col(lat1)) * t + F.sin(F.lit(3.141592653589793) * t) * 2,
        }
    )

"""Queries for profiles and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.catalog.base import legs, query, rounded, table
from skyfold.operators import quality as Q
from skyfold.operators.features import clean_nulls, fit_fill, repair_label
from skyfold.operators.relational import enforce_types
from skyfold.operators.splits import apply_holdout, holdout
from skyfold.session import stored


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Customers left-joined with suppliers: most supplier columns are null."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    both = customer.join(supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return both.select("c_custkey", "c_acctbal", "c_mktsegment", "s_name", "s_acctbal", "s_nationkey")


_GAPPY = """g AS (SELECT c_custkey, c_acctbal, c_mktsegment, s_name, s_acctbal, s_nationkey
    FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)"""
_GAPPY_TYPES = {
    "c_custkey": "Long",
    "c_acctbal": "Double",
    "c_mktsegment": "String",
    "s_name": "String",
    "s_acctbal": "Double",
    "s_nationkey": "Integer",
}
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count,
    round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_percent FROM g"""
    for c, t in _GAPPY_TYPES.items()
)


@query(f"WITH {_GAPPY} {_PROFILE}")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.null_profile(_gappy(spark, sf)), "null_percent")


@query(
    f"""WITH {_GAPPY}, p AS ({_PROFILE.replace('round(100.0 * ', '(100.0 * ').replace(', 6) AS null_percent', ') AS null_percent')})
    SELECT data_type, CAST(sum(null_count) AS BIGINT) AS total_null_count, count(*) AS num_columns,
    round(sum(null_percent), 6) AS null_percent FROM p GROUP BY 1"""
)
def type_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.nulls_by_type(_gappy(spark, sf)), "null_percent")


_CARD = ["l_suppkey", "l_linenumber", "l_returnflag", "l_partkey"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 400 AS over_limit FROM lineitem"
        for c in _CARD
    )
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cardinality of category columns against the largest number of bins."""
    return Q.distinct_counts(table(spark, sf, "lineitem"), _CARD, 400)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return Q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows,
      CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM c"""
)
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return Q.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


_SKEWED = {"l_quantity": "lineitem", "l_extendedprice": "lineitem"}


def _skew_sql(col: str, source: str) -> str:
    return f"""SELECT '{col}' AS column_name, round(avg(pow({col} - m, 3)) / pow(avg(pow({col} - m, 2)), 1.5), 6) AS skewness
    FROM {source}, (SELECT avg({col}) AS m FROM {source})"""


@query(f"{_skew_sql('l_quantity', 'lineitem')} UNION ALL {_skew_sql('l_extendedprice', 'lineitem')}")
def skew_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.skew_profile(table(spark, sf, "lineitem"), list(_SKEWED)), "skewness")


_SPREAD = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(stddev_samp({c}), 6) AS stddev FROM lineitem HAVING stddev_samp({c}) <= 0.03"
        for c in _SPREAD
    )
)
def low_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.low_variance(table(spark, sf, "lineitem"), _SPREAD, 0.03), "stddev")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_a, 'ARR_DEL15' AS column_b, round(corr("{c}", "ARR_DEL15"), 6) AS correlation FROM legs"""
        for c in ("ARR_DELAY", "DEP_DELAY", "DISTANCE")
    ),
    legs=True,
)
def label_correlation(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(Q.correlations(df, ["ARR_DELAY", "DEP_DELAY", "DISTANCE"], "ARR_DEL15"), "correlation")


_PAIR_COLS = ["ARR_DELAY", "l_quantity", "DISTANCE", "l_partkey"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr("{a}", "{b}"), 6) AS correlation FROM legs
        HAVING abs(corr("{a}", "{b}")) > 0.85"""
        for i, a in enumerate(_PAIR_COLS)
        for b in _PAIR_COLS[i + 1 :]
    ),
    legs=True,
)
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(Q.correlations(df, _PAIR_COLS, threshold=0.85), "correlation")


_SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey"]


@query(
    f"""WITH m AS (SELECT CASE WHEN g = 0 THEN CAST(year(l_shipdate) AS INTEGER) END AS y, {", ".join(_SKETCHED)} FROM lineitem, range(2) t(g))
    {" UNION ALL ".join(f"SELECT y AS year, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, true AS within_error FROM m GROUP BY 1, 2" for c in _SKETCHED)}"""
)
def distinct_by_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches kept per month, merged to years and to the whole, against exact counts: within five standard errors."""
    df = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), *_SKETCHED)
    kept = stored(Q.distinct_sketches(df, _SKETCHED, ["year", "month"]), "sketches")
    none = F.lit(None).cast("int").alias("year")
    merged = Q.merged_distinct(kept, _SKETCHED, ["year"]).unionByName(Q.merged_distinct(kept, _SKETCHED).select(none, *_SKETCHED))
    exact = df.groupBy("year").agg(*[F.count_distinct(c).alias(c) for c in _SKETCHED])
    exact = exact.unionByName(df.agg(*[F.count_distinct(c).alias(c) for c in _SKETCHED]).select(none, *_SKETCHED))
    long = [d.unpivot(["year"], _SKETCHED, "column_name", n) for d, n in ((merged, "estimate"), (exact, "n_distinct"))]
    same = long[0]["year"].eqNullSafe(long[1]["year"]) & (long[0]["column_name"] == long[1]["column_name"])
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= 5 * 0.8 / 64 * F.col("n_distinct") + 1
    return long[0].join(long[1], same).select(long[1]["year"], long[1]["column_name"], "n_distinct", near.alias("within_error"))


#: Sixty columns of the orders' lines: remainders of keys and quantities, every fifth with gaps.
_WIDE = [f"x{i}" for i in range(60)]


def _wide_sql(i: int) -> str:
    base = ("l_partkey", "l_suppkey", "l_orderkey", "CAST(l_quantity AS BIGINT)")[i % 4]
    value = f"CAST({base} % {7 + i} AS DOUBLE)"
    return f"CASE WHEN l_linenumber <> {1 + i % 7} THEN {value} END" if i % 5 == 0 else value


@query(
    f"""WITH w AS (SELECT {", ".join(f"{_wide_sql(i)} AS x{i}" for i in range(60))} FROM lineitem),
    c AS (SELECT {", ".join(f"corr(x{i}, x{j}) AS c{i}_{j}" for i in range(60) for j in range(i + 1, 60))} FROM w),
    u AS (UNPIVOT c ON * INTO NAME pair VALUE correlation)
    SELECT 'x' || split_part(substr(pair, 2), '_', 1) AS column_a, 'x' || split_part(pair, '_', 2) AS column_b, round(correlation, 6) AS correlation FROM u"""
)
def wide_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """All 1,770 pairs of sixty columns with gaps, from one Gram matrix."""
    df = table(spark, sf, "lineitem").select(*[F.expr(_wide_sql(i)).alias(f"x{i}") for i in range(60)])
    return rounded(Q.correlations(df, _WIDE), "correlation")


_FLAGS = ["CANCELLED", "DIVERTED", "ARR_DEL15"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(avg("{c}"), 6) AS positive_share,
        round(least(avg("{c}"), 1 - avg("{c}")), 6) AS minority_share, least(avg("{c}"), 1 - avg("{c}")) < 0.05 AS is_rare
        FROM legs"""
        for c in _FLAGS
    ),
    legs=True,
)
def flag_balance(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(Q.flag_balance(df, _FLAGS, 0.05), "positive_share", "minority_share")


@query(
    """WITH s AS (SELECT CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, o_orderdate
      FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '2000-01-01')
    SELECT split, min(o_orderdate) AS min_time, max(o_orderdate) AS max_time, count(*) AS n_rows,
      round(count(*) / sum(count(*)) OVER (), 6) AS row_share FROM s GROUP BY 1"""
)
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:


    split = apply_holdout(table(spark, sf, "orders"), "o_orderdate", holdout(dt.date(1995, 1, 1), 48, 12))
    return rounded(Q.split_coverage(split, "o_orderdate"), "row_share")


# ---------------------------------------------------------------- missing values and types


@query(
    f"""WITH {_GAPPY} SELECT c_custkey, coalesce(s_acctbal, (SELECT quantile_cont(s_acctbal, 0.5) FROM g)) AS s_acctbal,
    coalesce(s_nationkey, 0) AS s_nationkey, coalesce(s_name, 'none') AS s_name FROM g"""
)
def impute(spark: SparkSession, sf: str) -> DataFrame:
    """Zero, exact median and constant fills of a table with gaps."""
    df = _gappy(spark, sf)
    policy = fit_fill(df, zero=["s_nationkey"], medians=["s_acctbal"], constants={"s_name": "none"}, accuracy=None)
    return policy.apply(df).select("c_custkey", "s_acctbal", "s_nationkey", "s_name")


@query(
    f"""WITH {_GAPPY} SELECT * FROM (VALUES ('c_custkey', false), ('c_acctbal', false), ('c_mktsegment', false),
      ('s_name', true), ('s_acctbal', true), ('s_nationkey', false)) v(column_name, expected)
    JOIN ({' UNION ALL '.join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls_before, "
        + (f"count(*) - count({c})" if c == 's_name' else 'CAST(0 AS BIGINT)')
        + " AS nulls_after FROM g"
        for c in _GAPPY_TYPES)}) USING (column_name)"""
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls per column before and after cleaning, and whether they were expected."""
    _, _, report = clean_nulls(
        _gappy(spark, sf), zero=["s_nationkey"], medians=["s_acctbal"], constants={}, expected=["s_name", "s_acctbal"]
    )
    return report


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce("ARR_DEL15",
      CASE WHEN "ACTUAL_ELAPSED_TIME" - "CRS_ELAPSED_TIME" >= 15 THEN 1 ELSE 0 END) AS "ARR_DEL15" FROM legs""",
    legs=True,
)
def label_repair(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    fixed = repair_label(df, "ARR_DEL15", "ACTUAL_ELAPSED_TIME", "CRS_ELAPSED_TIME")
    return fixed.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ARR_DEL15")


@query(
    """SELECT l_orderkey, l_partkey, TRY_CAST("HourlyPrecipitation" AS DOUBLE) AS "HourlyPrecipitation",
      CAST("ARR_DELAY" AS INTEGER) AS "ARR_DELAY" FROM legs""",
    legs=True,
)
def type_enforcement(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    df = df.select("l_orderkey", "l_partkey", "HourlyPrecipitation", "ARR_DELAY")
    return enforce_types(df, {"HourlyPrecipitation": "double", "ARR_DELAY": "int"})

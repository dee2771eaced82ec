"""Queries for order-dependent operators: previous rows, ranks, running totals, as-of joins, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.catalog.base import legs, query, rounded, table
from skyfold.operators import ordered as O
from skyfold.operators.asof import asof_join, match_ratio, time_gap
from skyfold.operators.decompose import decompose
from skyfold.operators.features import previous_leg_features
from skyfold.operators.quality import leakage_audit
from skyfold.operators.reports import count_by, resample
from skyfold.operators.splits import ratio_split
from skyfold.plans import eda
from skyfold.session import scratch_path
from skyfold.sources.tables import write_bucketed

# ---------------------------------------------------------------- as-of join


def _purchases_with_error(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return asof_join(
        purchases,
        events.filter("event_type = 'error'"),
        key="user_id",
        left_ts="ts",
        right_ts="ts",
        cols={"event_id": "error_id", "ts": "error_ts", "value": "error_value"},
        tie="event_id",
    )


_ASOF = """l AS (SELECT event_id, user_id, ts, value, CAST(floor(epoch(ts)) AS BIGINT) - 3600 AS due FROM events
      WHERE event_type = 'purchase'),
    e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, max(event_id) AS error_id,
      arg_max(ts, event_id) AS error_ts, arg_max(value, event_id) AS error_value
      FROM events WHERE event_type = 'error' GROUP BY ALL),
    j AS (SELECT l.event_id, l.user_id, l.ts, l.value, CASE WHEN due - s <= 28800 THEN error_id END AS error_id,
      CASE WHEN due - s <= 28800 THEN error_ts END AS error_ts,
      CASE WHEN due - s <= 28800 THEN error_value END AS error_value
      FROM l ASOF LEFT JOIN e ON l.user_id = e.user_id AND l.due >= e.s)"""


@query(f"WITH {_ASOF} SELECT * FROM j")
def asof_event(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's newest error between one and nine hours before it."""
    return _purchases_with_error(spark, sf)


@query(
    f"""WITH {_ASOF} SELECT count(error_id) AS matched, count(*) AS total,
    round(count(error_id) / count(*), 6) AS matched_share FROM j"""
)
def asof_match_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(match_ratio(_purchases_with_error(spark, sf), "error_id"), "matched_share")


@query(
    f"""WITH {_ASOF} SELECT event_id, round((floor(epoch(ts)) - floor(epoch(error_ts))) / 3600, 6) AS gap_hours
    FROM j WHERE error_id IS NOT NULL"""
)
def asof_gap_hours(spark: SparkSession, sf: str) -> DataFrame:
    matched = _purchases_with_error(spark, sf).filter(F.col("error_id").isNotNull())
    return rounded(time_gap(matched, "ts", "error_ts").select("event_id", "gap_hours"), "gap_hours")


@query(
    """WITH w AS (SELECT l_suppkey, CAST(epoch(l_shipdate) AS BIGINT) AS s, max(l_extendedprice) AS price
      FROM lineitem GROUP BY 1, 2),
    o AS (SELECT o_orderkey, o_custkey % 50 AS k, CAST(epoch(o_orderdate) AS BIGINT) - 86400 AS due FROM orders)
    SELECT o_orderkey, CASE WHEN due - s <= 604800 THEN price END AS last_price
    FROM o ASOF LEFT JOIN w ON o.k = w.l_suppkey AND o.due >= w.s"""
)
def asof_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the dearest line of the newest shipping day of a supplier, one to eight days before."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("k"))
    shipped = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    out = asof_join(
        orders, shipped, key="k", right_key="l_suppkey", left_ts="o_orderdate", right_ts="l_shipdate",
        cols={"l_extendedprice": "last_price"}, tie="l_extendedprice",
        offset_seconds=86400, tolerance_seconds=604800,
    )
    return out.select("o_orderkey", "last_price")


# ---------------------------------------------------------------- previous rows


def _event_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as legs: 90 minutes planned, late by the whole part of the value less 20 minutes."""
    late = F.floor("value").cast("int") - 20
    planned = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "ts", late.alias("late"), planned.alias("planned_end"),
        (planned + F.make_dt_interval(mins=late)).alias("actual_end"),
    )


def _previous(df: DataFrame, key: str) -> DataFrame:
    return previous_leg_features(
        df, key=key, sched_dep="ts", sched_arr="planned_end", arr="actual_end", arr_delay="late", tie="event_id"
    )


def _prev_sql(key: str) -> str:
    return f"""e AS (SELECT event_id, user_id, event_type, ts, CAST(floor(value) AS INTEGER) - 20 AS late FROM events),
    x AS (SELECT *, ts + INTERVAL 90 MINUTE AS pe, ts + to_minutes(90 + late) AS ae FROM e),
    y AS (SELECT *, lag(late) OVER w AS pl, floor(epoch(lag(pe) OVER w)) AS ps, lag(pe) OVER w AS ppe,
      floor(epoch(lag(ae) OVER w)) AS pa, floor(epoch(ts)) AS d
      FROM x WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
    p AS (SELECT event_id, CASE WHEN pa < d - 3661 AND pl >= 0 THEN pl END AS prev_flight_arr_delay_clean,
      round((d - ps) / 60, 6) AS crs_time_to_next_flight_diff_mins,
      round(CASE WHEN pa < d - 3661 THEN (d - pa) / 60 END, 6) AS actual_to_crs_time_to_next_flight_diff_mins_clean,
      round((d - pa) / 3600, 6) AS leakage, ppe AS prev_crs_arr_time_utc FROM y)"""


_PREV_COLS = [
    "event_id",
    "prev_flight_arr_delay_clean",
    "crs_time_to_next_flight_diff_mins",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
    "leakage",
    "prev_crs_arr_time_utc",
]


@query(f"WITH {_prev_sql('user_id')} SELECT * FROM p")
def prev_leg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_previous(_event_legs(spark, sf), "user_id").select(*_PREV_COLS), *_PREV_COLS[2:5])


@query(f"WITH {_prev_sql('user_id')} SELECT * FROM p")
def prev_leg_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The same over events written in buckets by key, which the window reads without an exchange."""
    kept = write_bucketed(_event_legs(spark, sf), scratch_path(spark, "legs"), ["user_id"], sort=["user_id", "ts"])
    return rounded(_previous(kept, "user_id").select(*_PREV_COLS), *_PREV_COLS[2:5])


@query(f"WITH {_prev_sql('event_type')} SELECT * FROM p")
def prev_leg_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a key of five values, each of which holds a fifth of all rows."""
    return rounded(_previous(_event_legs(spark, sf), "event_type").select(*_PREV_COLS), *_PREV_COLS[2:5])


_AUDIT = ["prev_flight_arr_delay_clean", "actual_to_crs_time_to_next_flight_diff_mins_clean"]


@query(
    f"""WITH {_prev_sql('user_id')} SELECT
    count(*) FILTER (leakage < 3661 / 3600.0 AND {_AUDIT[0]} IS NOT NULL) AS {_AUDIT[0]}_violations,
    count(*) FILTER (leakage < 3661 / 3600.0 AND {_AUDIT[1]} IS NOT NULL) AS {_AUDIT[1]}_violations,
    count(*) FILTER (leakage < round(3661 / 3600.0, 6)) AS risk_rows, count(*) AS total_rows FROM p"""
)
def leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    return leakage_audit(_previous(_event_legs(spark, sf), "user_id"), "leakage", 3661 / 3600, _AUDIT)


# ---------------------------------------------------------------- ranks, shares, series


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS row_num FROM events")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers over a whole table without a one-task sort."""
    events = table(spark, sf, "events").select("event_id", "value")
    return O.global_rank(events, "value", "event_id", descending=True).select("event_id", "row_num")


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER () AS t
      FROM orders)
    SELECT o_orderkey, CASE WHEN n <= floor(t * 0.6) THEN 'train' WHEN n <= floor(t * 0.6) + floor(t * 0.2) THEN 'val'
      ELSE 'test' END AS split FROM r"""
)
def ratio_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """60/20/20 in order of time; many orders share a day, which the key orders further."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ratio_split(orders, "o_orderdate", "o_orderkey", [0.6, 0.2], ["train", "val", "test"]).select(
        "o_orderkey", "split"
    )


@query(
    """SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM customer
    GROUP BY 1"""
)
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    counts = count_by(table(spark, sf, "customer"), "c_mktsegment")
    return O.share_of_total(counts, {"n": "share"}, 4)


@query(
    """WITH c AS (SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
    SELECT l_suppkey, qty, round(100.0 * qty / sum(qty) OVER (), 6) AS share,
      round(100.0 * sum(qty) OVER (ORDER BY qty DESC, l_suppkey ROWS UNBOUNDED PRECEDING) / sum(qty) OVER (), 6)
      AS cumulative_share FROM c"""
)
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    qty = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    return rounded(O.cumulative_share(qty, "qty", "l_suppkey"), "share", "cumulative_share")


@query(
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(value, {p}), 6) AS quantile FROM events"
        for p in (0.05, 0.5, 0.95)
    )
)
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    probs = [0.05, 0.5, 0.95]
    found = O.exact_quantiles(table(spark, sf, "events"), "value", probs)
    return rounded(spark.createDataFrame(list(zip(probs, found, strict=True)), "prob double, quantile double"), "quantile")


_DECOMPOSE = """s AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY day) - 1) % {p} AS phase, {trend} AS trend
      FROM d),
    m AS (SELECT *, avg(v - trend) OVER (PARTITION BY k, phase) AS pm FROM s),
    l AS (SELECT k, avg(pm) AS level FROM (SELECT DISTINCT k, phase, pm FROM m) GROUP BY 1)"""


@query(
    "WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY 1, 2), "
    + _DECOMPOSE.format(
        p=7,
        trend="""CASE WHEN count(*) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
      THEN avg(v) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END""",
    )
    + """ SELECT m.k AS event_type, day, v AS n, CAST(phase AS INTEGER) AS phase, round(trend, 6) AS trend,
      round(pm - level, 6) AS seasonal, round(v - trend - (pm - level), 6) AS residual FROM m JOIN l ON m.k = l.k"""
)
def decompose_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Daily event counts per type, weekly season."""
    daily = count_by(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"])
    return rounded(decompose(daily, "event_type", "day", "n", 7), "trend", "seasonal", "residual")


_MONTHLY_TREND = """CASE WHEN count(*) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
      THEN (sum(v) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
        + (lag(v, 6) OVER (PARTITION BY k ORDER BY day) + lead(v, 6) OVER (PARTITION BY k ORDER BY day)) / 2) / 12 END"""


@query(
    """WITH d AS (SELECT "OP_UNIQUE_CARRIER" AS k, CAST(date_trunc('month', "FL_DATE") AS DATE) AS day, avg(r) AS v
      FROM (SELECT "OP_UNIQUE_CARRIER", "FL_DATE", 100.0 * sum("ARR_DEL15") / count(*) AS r FROM legs GROUP BY 1, 2)
      GROUP BY 1, 2), """
    + _DECOMPOSE.format(p=12, trend=_MONTHLY_TREND)
    + """ SELECT m.k AS "OP_UNIQUE_CARRIER", day AS period, round(v, 6) AS delay_rate, CAST(phase AS INTEGER) AS phase,
      round(trend, 6) AS trend, round(pm - level, 6) AS seasonal, round(v - trend - (pm - level), 6) AS residual
    FROM m JOIN l ON m.k = l.k""",
    legs=True,
)
def decompose_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly mean of the daily delay rate per carrier, yearly season."""
    daily = eda.daily_series(legs(spark, sf, origin=False, dest=False), ["OP_UNIQUE_CARRIER"])
    monthly = resample(daily, "FL_DATE", "month", "delay_rate", by=["OP_UNIQUE_CARRIER"])
    out = decompose(monthly, "OP_UNIQUE_CARRIER", "period", "delay_rate", 12)
    return rounded(out, "delay_rate", "trend", "seasonal", "residual")

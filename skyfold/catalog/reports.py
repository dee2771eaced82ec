"""Queries for grouped reports on the flight-like view and on single tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.catalog.base import legs, query, rounded, table
from skyfold.operators import reports as P
from skyfold.operators.ordered import top_n_per_group
from skyfold.operators.relational import tagged_union
from skyfold.plans import eda

_RATE = "CAST(sum(\"ARR_DEL15\") AS BIGINT) AS delayed_flights, round(100.0 * sum(\"ARR_DEL15\") / count(*), 6) AS delay_pct"


@query('SELECT "YEAR", count(*) AS num_flights FROM legs GROUP BY 1', legs=True)
def flights_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return eda.flights_per_year(legs(spark, sf, carrier=False, origin=False, dest=False))


@query(
    """SELECT "OP_UNIQUE_CARRIER", count(*) AS num_flights, CAST(sum("ARR_DEL15") AS BIGINT) AS num_delayed_flights,
      round(sum("ARR_DEL15") / count(*) * 100, 2) AS delay_pct,
      round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct_total,
      round(sum("ARR_DEL15") / sum(sum("ARR_DEL15")) OVER () * 100, 2) AS pct_total_delayed
    FROM legs GROUP BY 1""",
    legs=True,
)
def carrier_rate_share(spark: SparkSession, sf: str) -> DataFrame:
    return eda.delay_by_airline(legs(spark, sf, origin=False, dest=False))


@query(
    f"""SELECT "ORIGIN", count(*) AS total_flights, {_RATE} FROM legs GROUP BY 1
    ORDER BY delayed_flights DESC, "ORIGIN" LIMIT 10""",
    legs=True,
)
def top_delayed_origins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.top_delayed(legs(spark, sf, carrier=False, dest=False), "ORIGIN"), "delay_pct")


@query(
    f"""SELECT "DEST", count(*) AS total_flights, {_RATE} FROM legs GROUP BY 1
    ORDER BY delayed_flights DESC, "DEST" LIMIT 10""",
    legs=True,
)
def top_delayed_destinations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.top_delayed(legs(spark, sf, origin=False), "DEST"), "delay_pct")


@query(
    """SELECT "OP_UNIQUE_CARRIER", round(avg("DISTANCE"), 6) AS avg_distance, count(*) AS total_flights
    FROM legs GROUP BY 1""",
    legs=True,
)
def distance_by_carrier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.distance_by_airline(legs(spark, sf, origin=False, dest=False)), "avg_distance")


@query(
    """SELECT CAST(year("FL_DATE") AS INTEGER) AS year, CAST(quarter("FL_DATE") AS INTEGER) AS quarter, "OP_UNIQUE_CARRIER",
      round(avg("ARR_DEL15"), 6) AS delay_pct, year("FL_DATE") || ' Q' || quarter("FL_DATE") AS period
    FROM legs GROUP BY ALL""",
    legs=True,
)
def quarterly_rate(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, origin=False, dest=False).drop("YEAR", "QUARTER")
    return rounded(eda.delay_by_quarter(df), "delay_pct")


@query(
    """WITH cells AS (SELECT year("FL_DATE") AS y, quarter("FL_DATE") AS q, "OP_UNIQUE_CARRIER" AS c,
      avg("ARR_DEL15") AS r FROM legs GROUP BY ALL)
    SELECT * FROM (SELECT 'worst' AS which, CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter,
      c AS "OP_UNIQUE_CARRIER", round(r, 6) AS delay_pct FROM cells ORDER BY r DESC, y, q, c LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'best', CAST(y AS INTEGER), CAST(q AS INTEGER), c, round(r, 6)
      FROM cells ORDER BY r, y, q, c LIMIT 1)""",
    legs=True,
)
def best_worst_cell(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, origin=False, dest=False).drop("YEAR", "QUARTER")
    return rounded(eda.best_worst_quarter(df), "delay_pct")


@query(
    "SELECT \"OP_UNIQUE_CARRIER\", "
    + ", ".join(
        f"coalesce(round(100.0 * sum(\"ARR_DEL15\") FILTER (\"ORIGIN\" = 'NATION_{i}')"
        f" / count(*) FILTER (\"ORIGIN\" = 'NATION_{i}'), 6), -1) AS \"NATION_{i}\""
        for i in range(25)
    )
    + " FROM legs GROUP BY 1",
    legs=True,
)
def carrier_airport_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """All 25 places as columns, in the order of their traffic."""
    df = legs(spark, sf, dest=False)
    names = [f"NATION_{i}" for i in range(25)]
    out = eda.airline_airport_matrix(df, 25)
    missing = {n: F.lit(-1.0) for n in names if n not in out.columns}
    out = out.withColumns(missing) if missing else out
    return rounded(out, *names)


@query(
    f"""WITH r AS (SELECT "ORIGIN", "ORIGIN_STATE_ABR", "ORIGIN_SIZE", count(*) AS total_flights, {_RATE},
      round(avg("ARR_DELAY") FILTER ("ARR_DELAY" > 0), 6) AS avg_delay_minutes FROM legs GROUP BY 1, 2, 3)
    SELECT *, coalesce("ORIGIN_SIZE", 'Unknown') AS airport_size FROM r
    WHERE total_flights >= 50 AND avg_delay_minutes IS NOT NULL""",
    legs=True,
)
def airport_delays(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.airport_delays(legs(spark, sf, carrier=False, dest=False)), "delay_pct", "avg_delay_minutes")


@query(
    """WITH r AS (SELECT "ORIGIN", "ORIGIN_SIZE", count(*) AS n, 100.0 * sum("ARR_DEL15") / count(*) AS pct,
      avg("ARR_DELAY") FILTER ("ARR_DELAY" > 0) AS m FROM legs GROUP BY ALL)
    SELECT coalesce("ORIGIN_SIZE", 'Unknown') AS airport_size, count("ORIGIN") AS num_airports,
      round(avg(pct), 2) AS avg_delay_pct, round(avg(m), 2) AS avg_delay_minutes, CAST(sum(n) AS BIGINT) AS total_flights
    FROM r WHERE n >= 50 AND m IS NOT NULL GROUP BY 1""",
    legs=True,
)
def summary_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return eda.summary_by_size(legs(spark, sf, carrier=False, dest=False))


@query(
    f"""WITH r AS (SELECT "ORIGIN", "ORIGIN_STATE_ABR", "ORIGIN_SIZE", count(*) AS total_flights, {_RATE},
      round(avg("ARR_DELAY") FILTER ("ARR_DELAY" > 0), 6) AS avg_delay_minutes FROM legs GROUP BY 1, 2, 3)
    SELECT *, coalesce("ORIGIN_SIZE", 'Unknown') AS airport_size FROM r
    WHERE total_flights >= 50 AND avg_delay_minutes IS NOT NULL
    ORDER BY total_flights DESC, "ORIGIN" LIMIT 15""",
    legs=True,
)
def busiest_airports(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.busiest_airports(legs(spark, sf, carrier=False, dest=False)), "delay_pct", "avg_delay_minutes")


_ROUTES = """routes AS (SELECT "ORIGIN", "DEST", TRY_CAST("ORIGIN_LAT" AS DOUBLE) AS "ORIGIN_LAT",
      TRY_CAST("ORIGIN_LONG" AS DOUBLE) AS "ORIGIN_LONG", TRY_CAST("DEST_LAT" AS DOUBLE) AS "DEST_LAT",
      TRY_CAST("DEST_LON" AS DOUBLE) AS "DEST_LON", count(*) AS total_flights,
      CAST(sum("ARR_DEL15") AS BIGINT) AS delayed_flights, 100.0 * sum("ARR_DEL15") / count(*) AS pct
    FROM legs WHERE "CANCELLED" = 0 GROUP BY ALL HAVING count(*) >= 50
      AND "DEST_LAT" BETWEEN 24 AND 50 AND "DEST_LON" BETWEEN -125 AND -65)"""


@query(
    f"""WITH {_ROUTES} SELECT * EXCLUDE (pct), round(pct, 6) AS delay_pct FROM routes WHERE "ORIGIN" = 'NATION_5'
    ORDER BY pct DESC, "DEST" LIMIT 20""",
    legs=True,
)
def routes_per_origin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.routes_from(legs(spark, sf), "NATION_5"), "delay_pct")


@query(
    f"""WITH {_ROUTES}, top AS (SELECT "ORIGIN" AS o FROM legs WHERE "CANCELLED" = 0 GROUP BY 1
      ORDER BY sum("ARR_DEL15") DESC, 1 LIMIT 5)
    SELECT * EXCLUDE (pct), round(pct, 6) AS delay_pct,
      CAST(row_number() OVER (PARTITION BY "ORIGIN" ORDER BY pct DESC, "DEST") AS INTEGER) AS rank
    FROM routes WHERE "ORIGIN" IN (SELECT o FROM top) QUALIFY rank <= 12""",
    legs=True,
)
def route_rate_topn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.worst_routes_of_top_origins(legs(spark, sf)), "delay_pct")


@query(
    """WITH o AS (SELECT "ORIGIN_CITY_NAME" AS city, count(*) AS n, sum("ARR_DEL15") AS d FROM legs GROUP BY 1),
    t AS (SELECT "DEST_CITY_NAME" AS city, count(*) AS n, sum("ARR_DEL15") AS d FROM legs GROUP BY 1)
    SELECT coalesce(o.city, t.city) AS city, coalesce(o.n, 0) AS origin_total,
      CAST(coalesce(o.d, 0) AS BIGINT) AS origin_delayed, round(coalesce(100.0 * o.d / o.n, 0), 6) AS origin_delay_pct,
      coalesce(t.n, 0) AS dest_total, CAST(coalesce(t.d, 0) AS BIGINT) AS dest_delayed,
      round(coalesce(100.0 * t.d / t.n, 0), 6) AS dest_delay_pct,
      CAST(coalesce(o.d, 0) + coalesce(t.d, 0) AS BIGINT) AS total_delayed
    FROM o FULL JOIN t ON o.city = t.city ORDER BY total_delayed DESC, city LIMIT 20""",
    legs=True,
)
def city_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.city_delays(legs(spark, sf)), "origin_delay_pct", "dest_delay_pct")


_CONTINGENCY = """SELECT n AS total, p AS persistent, r AS recovered, w AS "new", c AS "clear", p + r AS a_set,
      w + c AS a_unset, round(100.0 * (p + r) / n, 6) AS a_set_pct, round(100.0 * (w + c) / n, 6) AS a_unset_pct,
      round(100.0 * p / (p + r), 6) AS persistent_pct, round(100.0 * r / (p + r), 6) AS recovered_pct,
      round(100.0 * w / (w + c), 6) AS new_pct, round(100.0 * c / (w + c), 6) AS clear_pct FROM cells"""
_PCTS = [f"{c}_pct" for c in ("a_set", "a_unset", "persistent", "recovered", "new", "clear")]


def _cells(a: str, b: str, source: str) -> str:
    return f"""cells AS (SELECT count(*) AS n, count(*) FILTER ({a} = 1 AND {b} = 1) AS p,
      count(*) FILTER ({a} = 1 AND {b} = 0) AS r, count(*) FILTER ({a} = 0 AND {b} = 1) AS w,
      count(*) FILTER ({a} = 0 AND {b} = 0) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_DEP, _ARR = '"DEP_DEL15"', '"ARR_DEL15"'


@query(f"WITH {_cells(_DEP, _ARR, 'legs')} {_CONTINGENCY}", legs=True)
def delay_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.delay_contingency(legs(spark, sf, carrier=False, origin=False, dest=False)), *_PCTS)


@query(f"WITH {_cells('quality', 'toxic', 'labels')} {_CONTINGENCY}")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.contingency(table(spark, sf, "labels"), "quality", "toxic"), *_PCTS)


@query(
    "SELECT \"OP_UNIQUE_CARRIER\", "
    + ", ".join(
        f'coalesce(round(100.0 * sum("ARR_DEL15") FILTER ("CRS_DEP_HOUR" = {h})'
        f' / count(*) FILTER ("CRS_DEP_HOUR" = {h}), 6), -1) AS h{h}'
        for h in range(24)
    )
    + " FROM legs GROUP BY 1",
    legs=True,
)
def rate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Carrier by hour, hours 0 to 23 always present."""
    return rounded(eda.hour_airline_matrix(legs(spark, sf, origin=False, dest=False)), *[f"h{h}" for h in range(24)])


@query(
    "SELECT \"CRS_DEP_HOUR\", "
    + ", ".join(
        f'coalesce(round(100.0 * sum("ARR_DEL15") FILTER ("DAY_OF_WEEK" = {i + 1})'
        f' / count(*) FILTER ("DAY_OF_WEEK" = {i + 1}), 6), 0) AS "{n}"'
        for i, n in enumerate(eda.WEEKDAYS)
    )
    + " FROM legs GROUP BY 1",
    legs=True,
)
def hour_weekday_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        eda.hour_weekday_matrix(legs(spark, sf, carrier=False, origin=False, dest=False)), *eda.WEEKDAYS
    )


def _case(col: str, names: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(names)) + " END"


_DELAY_RATE = _RATE.replace("delay_pct", "delay_rate")


@query(
    f"""SELECT "DAY_OF_WEEK", count(*) AS total_flights, {_DELAY_RATE}, {_case('"DAY_OF_WEEK"', eda.WEEKDAYS)} AS day_name
    FROM legs GROUP BY "DAY_OF_WEEK" """,
    legs=True,
)
def by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.by_weekday(legs(spark, sf, carrier=False, origin=False, dest=False)), "delay_rate")


@query(
    f"""SELECT "MONTH", count(*) AS total_flights, {_DELAY_RATE}, {_case('"MONTH"', eda.MONTHS)} AS month_name
    FROM legs GROUP BY "MONTH" """,
    legs=True,
)
def by_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.by_month(legs(spark, sf, carrier=False, origin=False, dest=False)), "delay_rate")


@query(f'SELECT "FL_DATE", count(*) AS total_flights, {_DELAY_RATE} FROM legs GROUP BY 1', legs=True)
def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.daily_series(legs(spark, sf, carrier=False, origin=False, dest=False)), "delay_rate")


@query(
    """WITH d AS (SELECT "FL_DATE", 100.0 * sum("ARR_DEL15") / count(*) AS r FROM legs GROUP BY 1)
    SELECT CAST(date_trunc('month', "FL_DATE") AS DATE) AS period, round(avg(r), 6) AS delay_rate FROM d GROUP BY 1""",
    legs=True,
)
def monthly_resample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.monthly_series(legs(spark, sf, carrier=False, origin=False, dest=False)), "delay_rate")


@query(
    """SELECT "DAY_OF_MONTH", CASE WHEN "CANCELLED" = 1 THEN 'Canceled' WHEN "ARR_DEL15" = 1 THEN 'Delayed'
      ELSE 'On Time' END AS flight_status, count(*) AS num_flights FROM legs GROUP BY 1, 2""",
    legs=True,
)
def status_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return eda.status_by_day(legs(spark, sf, carrier=False, origin=False, dest=False))


@query(
    """SELECT CASE WHEN "HourlyWindSpeed" < 5 THEN '0–5 mph' WHEN "HourlyWindSpeed" < 15 THEN '5–15 mph'
      WHEN "HourlyWindSpeed" < 25 THEN '15–25 mph' ELSE '25+ mph' END AS "WIND_BIN",
      round(avg("ARR_DEL15"), 6) AS pct_delayed FROM legs GROUP BY 1""",
    legs=True,
)
def wind_bin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.wind_bins(legs(spark, sf, carrier=False, origin=False, dest=False)), "pct_delayed")


@query(
    """SELECT CASE WHEN "HourlyWindSpeed" IS NULL THEN 'unknown' WHEN "HourlyWindSpeed" < 5 THEN '0–5 mph'
      WHEN "HourlyWindSpeed" < 15 THEN '5–15 mph' WHEN "HourlyWindSpeed" < 25 THEN '15–25 mph' ELSE '25+ mph' END
      AS "WIND_BIN", round(avg("ARR_DEL15"), 6) AS pct_delayed FROM legs GROUP BY 1""",
    legs=True,
)
def wind_bin_null_apart(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(eda.wind_bins(df, "unknown"), "pct_delayed")


@query(
    """SELECT CASE WHEN "DISTANCE" < 500 THEN '<500 ft (Very low)' WHEN "DISTANCE" < 1000 THEN '500–1000 ft'
      WHEN "DISTANCE" < 2000 THEN '1000–2000 ft' ELSE '>2000 ft' END AS "CEILING_BIN",
      round(avg("ARR_DEL15"), 6) AS pct_delayed FROM legs GROUP BY 1""",
    legs=True,
)
def ceiling_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Ceiling bins, with the distance standing in for a ceiling."""
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(eda.ceiling_effect(df, "DISTANCE"), "pct_delayed")


@query(
    """SELECT ("CANCELLED" + "DIVERTED" + coalesce("DEP_DEL15", 0)) > 0 AS "ANY_PRECIP",
      round(avg("ARR_DEL15"), 6) AS pct_delayed FROM legs GROUP BY 1""",
    legs=True,
)
def any_flag_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Rate with and without any of several flags set."""
    df = legs(spark, sf, carrier=False, origin=False, dest=False).fillna(0, ["DEP_DEL15"])
    return rounded(eda.precipitation_effect(df, ["CANCELLED", "DIVERTED", "DEP_DEL15"]), "pct_delayed")


@query(
    """WITH w AS (SELECT "ORIGIN", "ORIGIN_CITY_NAME" AS "NAME", "ORIGIN_LAT" AS "LATITUDE",
      "ORIGIN_LONG" AS "LONGITUDE", coalesce(TRY_CAST("HourlyPrecipitation" AS DOUBLE), 0) AS p FROM legs)
    SELECT "ORIGIN", "NAME", "LATITUDE", "LONGITUDE", count(*) AS obs_count, round(avg(p), 6) AS avg_precip,
      count(*) FILTER (p > 0) AS n_precip, round(100.0 * count(*) FILTER (p > 0) / count(*), 6) AS pct_precip
    FROM w GROUP BY 1, 2, 3, 4 HAVING count(*) >= 50""",
    legs=True,
)
def station_precipitation(spark: SparkSession, sf: str) -> DataFrame:
    names = {"ORIGIN_CITY_NAME": "NAME", "ORIGIN_LAT": "LATITUDE", "ORIGIN_LONG": "LONGITUDE"}
    df = legs(spark, sf, carrier=False, dest=False).withColumnsRenamed(names)
    return rounded(eda.station_precipitation(df), "avg_precip", "pct_precip")


@query(
    """SELECT "ORIGIN", "ORIGIN_SIZE", round(avg("HourlyWindSpeed"), 6) AS avg_wind_speed,
      round(least(100 * avg("ARR_DEL15"), 60), 6) AS delay_rate FROM legs WHERE "ORIGIN_SIZE" IS NOT NULL GROUP BY 1, 2""",
    legs=True,
)
def wind_vs_delay(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, dest=False)
    return rounded(eda.wind_vs_delay(df), "avg_wind_speed", "delay_rate")


@query(
    """SELECT CAST("CRS_DEP_TIME" // 100 AS INTEGER) AS "DEP_HOUR", round(avg("HourlyWindSpeed"), 6) AS avg_wind_speed
    FROM legs GROUP BY 1""",
    legs=True,
)
def wind_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.wind_by_hour(legs(spark, sf, carrier=False, origin=False, dest=False)), "avg_wind_speed")


@query('SELECT "MONTH", round(avg("HourlyWindSpeed"), 6) AS avg_wind_speed FROM legs GROUP BY 1', legs=True)
def wind_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.wind_by_month(legs(spark, sf, carrier=False, origin=False, dest=False)), "avg_wind_speed")


_CAUSE_CASES = """CASE WHEN "CARRIER_DELAY" > 0 THEN 'Carrier' END, CASE WHEN "WEATHER_DELAY" > 0 THEN 'Weather' END,
      CASE WHEN "NAS_DELAY" > 0 THEN 'Nas' END, CASE WHEN "SECURITY_DELAY" > 0 THEN 'Security' END,
      CASE WHEN "LATE_AIRCRAFT_DELAY" > 0 THEN 'Late Aircraft' END"""


@query(
    f"""WITH c AS (SELECT concat_ws(' & ', {_CAUSE_CASES}) AS delay_combo FROM legs)
    SELECT delay_combo, count(*) AS num_flights, CASE WHEN count(*) >= 1000 AND count(*) % 1000 = 0
      THEN (count(*) // 1000) || 'K' WHEN count(*) >= 1000 THEN printf('%.1fK', count(*) / 1000.0)
      ELSE CAST(count(*) AS VARCHAR) END AS num_flights_label FROM c WHERE delay_combo <> '' GROUP BY 1""",
    legs=True,
)
def cause_combo(spark: SparkSession, sf: str) -> DataFrame:
    return eda.cause_combos(legs(spark, sf, carrier=False, origin=False, dest=False))


_CAUSE_ROUTES = f"""e AS (SELECT "ORIGIN" || ' → ' || "DEST" AS route, unnest([{_CAUSE_CASES}]) AS cause FROM legs),
    k AS (SELECT route, cause, count(*) AS num_delayed_flights FROM e WHERE cause IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cause ORDER BY num_delayed_flights DESC, route) AS INTEGER)
      AS rank FROM k QUALIFY rank <= 10)"""


@query(f"WITH {_CAUSE_ROUTES} SELECT * FROM r", legs=True)
def cause_routes(spark: SparkSession, sf: str) -> DataFrame:
    return eda.top_routes_per_cause(legs(spark, sf))


@query(
    f"WITH {_CAUSE_ROUTES} SELECT cause, CAST(sum(num_delayed_flights) AS BIGINT) AS total_count FROM r GROUP BY 1",
    legs=True,
)
def cause_totals(spark: SparkSession, sf: str) -> DataFrame:
    return eda.cause_totals(legs(spark, sf))


@query(
    f"WITH {_CAUSE_ROUTES} SELECT route, CAST(sum(num_delayed_flights) AS BIGINT) AS total_count FROM r GROUP BY 1",
    legs=True,
)
def cause_route_totals(spark: SparkSession, sf: str) -> DataFrame:
    return eda.cause_route_totals(legs(spark, sf))


@query(
    """SELECT "ORIGIN", "DEST", count(*) AS num_flights FROM legs GROUP BY 1, 2
    ORDER BY num_flights DESC, 1, 2 LIMIT 10""",
    legs=True,
)
def popular_routes(spark: SparkSession, sf: str) -> DataFrame:
    return eda.popular_routes(legs(spark, sf))


@query(
    """WITH top AS (SELECT "ORIGIN" AS o FROM legs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    SELECT "ORIGIN", "DEST", count(*) AS num_flights,
      CAST(row_number() OVER (PARTITION BY "ORIGIN" ORDER BY count(*) DESC, "DEST") AS INTEGER) AS rank
    FROM legs WHERE "ORIGIN" IN (SELECT o FROM top) GROUP BY 1, 2 QUALIFY rank <= 3""",
    legs=True,
)
def top_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """The three main destinations of the ten busiest origins."""
    df = legs(spark, sf)
    origins = P.count_by(legs(spark, sf, carrier=False, dest=False), "ORIGIN").orderBy(F.desc("n"), "ORIGIN").limit(10)
    return eda.top_destinations(df, origins)


@query('SELECT "ARR_DEL15", count(*) AS n_rows FROM legs GROUP BY 1', legs=True)
def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    return eda.label_balance(legs(spark, sf, carrier=False, origin=False, dest=False))


@query(
    """WITH d AS (SELECT "ARR_DELAY" AS v FROM legs WHERE "CANCELLED" = 0 AND "ARR_DEL15" = 1 AND "ARR_DELAY" <= 300),
    r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 60 AS w FROM d)
    SELECT CAST(least(floor((v - lo) / w), 59) AS INTEGER) AS bin, count(*) AS n,
      round(any_value(lo + least(floor((v - lo) / w), 59) * w), 6) AS bin_from,
      round(any_value(lo + (least(floor((v - lo) / w), 59) + 1) * w), 6) AS bin_to FROM d, r GROUP BY 1""",
    legs=True,
)
def delay_histogram(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return rounded(eda.arrival_delay_histogram(df), "bin_from", "bin_to")


@query(
    """WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 60 AS w FROM events)
    SELECT CAST(least(floor((value - lo) / w), 59) AS INTEGER) AS bin, count(*) AS n,
      round(any_value(lo + least(floor((value - lo) / w), 59) * w), 6) AS bin_from,
      round(any_value(lo + (least(floor((value - lo) / w), 59) + 1) * w), 6) AS bin_to FROM events, r GROUP BY 1"""
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.histogram(table(spark, sf, "events"), "value", 60), "bin_from", "bin_to")


@query("SELECT min(o_orderdate) AS min_value, max(o_orderdate) AS max_value FROM orders")
def min_max_range(spark: SparkSession, sf: str) -> DataFrame:
    return P.min_max(table(spark, sf, "orders"), "o_orderdate")


@query(
    """SELECT event_type, round(avg(value) FILTER (value > 50), 6) AS avg_large, count(*) AS n
    FROM events GROUP BY 1"""
)
def conditional_average(spark: SparkSession, sf: str) -> DataFrame:
    large = P.avg_where("value", F.col("value") > 50).alias("avg_large")
    out = table(spark, sf, "events").groupBy("event_type").agg(large, F.count(F.lit(1)).alias("n"))
    return rounded(out, "avg_large")


_PERIODS = {"before_1998": "YEAR < 1998", "from_1998": "YEAR >= 1998", "all": "true"}


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS dataset_name, count(*) AS total_rows, count(*) FILTER ("ARR_DEL15" = 0) AS class_0_count,
        count(*) FILTER ("ARR_DEL15" = 1) AS class_1_count,
        round(100.0 * count(*) FILTER ("ARR_DEL15" = 1) / count(*), 2) AS class_1_pct,
        min("FL_DATE") AS start_date, max("FL_DATE") AS end_date FROM legs WHERE {w}"""
        for n, w in _PERIODS.items()
    ),
    legs=True,
)
def dataset_comparison(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return P.compare_datasets(df, {n: F.expr(w) for n, w in _PERIODS.items()}, "ARR_DEL15", "FL_DATE")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1")
def majority_class(spark: SparkSession, sf: str) -> DataFrame:
    return P.majority_class(table(spark, sf, "events"), "event_type")


@query(
    """SELECT "ORIGIN", round(avg("ARR_DEL15"), 6) AS score, arg_min("ORIGIN_LAT", l_suppkey) AS "ORIGIN_LAT",
      arg_min("ORIGIN_LONG", l_suppkey) AS "ORIGIN_LONG" FROM legs GROUP BY 1""",
    legs=True,
)
def node_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, dest=False)
    return rounded(P.node_summary(df, "ORIGIN", "ARR_DEL15", ["ORIGIN_LAT", "ORIGIN_LONG"], "l_suppkey"), "score")


@query(
    """SELECT count(*) FILTER (l_quantity > 49) AS too_many, count(*) FILTER (l_shipdate < o_orderdate) AS early_ship,
      count(*) FILTER (l_tax = 0) AS untaxed, count(*) AS total_rows
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rules = {
        "too_many": F.col("l_quantity") > 49,
        "early_ship": F.col("l_shipdate") < F.col("o_orderdate"),
        "untaxed": F.col("l_tax") == 0,
    }
    return P.count_violations(df, rules)


@query(
    """WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
    SELECT event_id, value, value >= hi OR value <= lo AS is_extreme FROM events, q"""
)
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles found without gathering the values in one task."""
    return P.flag_extremes(table(spark, sf, "events").select("event_id", "value"), "value", 0.05, 0.95)


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INTEGER)
      AS rank FROM c QUALIFY rank <= 10"""
)
def top_n_per_group_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.count_by(table(spark, sf, "events"), ["user_id", "event_type"])
    return top_n_per_group(counts, "event_type", "n", 10, "user_id")


@query(
    """WITH r AS (SELECT "ORIGIN", "DEST", CAST(any_value("ORIGIN_LAT") AS DOUBLE) AS lat1,
      CAST(any_value("ORIGIN_LONG") AS DOUBLE) AS lon1, CAST(any_value("DEST_LON") AS DOUBLE) AS lon2,
      TRY_CAST(any_value("DEST_LAT") AS DOUBLE) AS lat2 FROM legs GROUP BY 1, 2)
    SELECT "ORIGIN", "DEST", CAST(s AS INTEGER) AS step, round(lon1 + (lon2 - lon1) * (s / 99.0), 6) AS lon,
      round(lat1 + (lat2 - lat1) * (s / 99.0) + sin(3.141592653589793 * (s / 99.0)) * 2, 6) AS lat
    FROM r, range(100) t(s) WHERE lat2 IS NOT NULL""",
    legs=True,
)
def route_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """Every route as an arc of 100 points."""
    df = legs(spark, sf)
    ends = df.groupBy("ORIGIN", "DEST").agg(
        *[F.first(c).try_cast("double").alias(c) for c in ("ORIGIN_LAT", "ORIGIN_LONG", "DEST_LAT", "DEST_LON")]
    )
    arcs = P.curved_path(ends.filter(F.col("DEST_LAT").isNotNull()), "ORIGIN_LONG", "ORIGIN_LAT", "DEST_LON", "DEST_LAT")
    return rounded(arcs.select("ORIGIN", "DEST", "step", "lon", "lat"), "lon", "lat")


@query(
    """SELECT 'customer' AS side, round(avg(c_acctbal), 6) AS mean_balance, count(*) AS n FROM customer
    UNION ALL SELECT 'supplier', round(avg(s_acctbal), 6), count(*) FROM supplier"""
)
def tagged_means(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables united with a tag, then summarised per tag."""
    sides = {
        n: table(spark, sf, n).select(F.col(f"{n[0]}_acctbal").alias("balance")) for n in ("customer", "supplier")
    }
    both = tagged_union(sides, "side")
    aggs = {"mean_balance": F.avg("balance"), "n": F.count(F.lit(1))}
    return rounded(P.summarise_report(both, "side", aggs), "mean_balance")


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS report, concat_ws('|', {", ".join(f'CAST("{c}" AS VARCHAR)' for c in keys)}) AS keys, count(*) AS total_flights,
        CAST(sum("ARR_DEL15") AS BIGINT) AS delayed_flights, round(100.0 * sum("ARR_DEL15") / count(*), 6) AS delay_pct,
        sum(CASE WHEN "ARR_DELAY" > 0 THEN "ARR_DELAY" END) AS late_minutes FROM legs GROUP BY ALL"""
        for name, keys in eda.CUBE_SETS.items()
    ),
    legs=True,
)
def cube_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve rate reports from the partials of one scan."""
    reports = eda.reports_from_cube(eda.report_cube(legs(spark, sf)))
    long = [
        df.select(
            F.lit(name).alias("report"), F.concat_ws("|", *[F.col(c).cast("string") for c in eda.CUBE_SETS[name]]).alias("keys"),
            "total_flights", "delayed_flights", "delay_pct", "late_minutes",
        )
        for name, df in reports.items()
    ]
    return rounded(reduce(DataFrame.unionByName, long), "delay_pct")

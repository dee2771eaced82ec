"""Descriptive reports on a flight table. Each takes the (enriched) flights and returns a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.config import CAUSE_COLUMNS, CEILING_BINS, CONTINENTAL_BOX, MONTHS, WEEKDAYS, WIND_BINS
from skyfold.functions.labels import (
    bin_label,
    category_rank,
    cause_combo,
    explode_causes,
    label_codes,
    route_label,
    status_label,
    thousands_label,
)
from skyfold.operators.ordered import share_of_total, top_n_per_group
from skyfold.operators.relational import coerce, in_box, top_k, where_all
from skyfold.operators.reports import (
    avg_where,
    busiest,
    contingency,
    count_by,
    histogram,
    mean_by,
    mean_flag_by,
    rate,
    rate_by,
    rate_cube,
    rate_matrix,
    rates_from,
    resample,
    summarise_report,
)
from skyfold.session import stored

LATE = "ARR_DEL15"
CARRIER = "OP_UNIQUE_CARRIER"
NAMES = {"total": "total_flights", "flagged": "delayed_flights", "rate_col": "delay_pct"}
WEEKDAY_NAMES = {i + 1: n for i, n in enumerate(WEEKDAYS)}
MONTH_NAMES = {i + 1: n for i, n in enumerate(MONTHS)}


#: Groupings of the rate reports that a cube holds.
CUBE_SETS = {
    "year": ["YEAR"],
    "airline": [CARRIER],
    "origin": ["ORIGIN"],
    "destination": ["DEST"],
    "weekday": ["DAY_OF_WEEK"],
    "month": ["MONTH"],
    "hour_airline": ["CRS_DEP_HOUR", CARRIER],
    "hour_weekday": ["CRS_DEP_HOUR", "DAY_OF_WEEK"],
    "quarter_airline": ["YEAR", "QUARTER", CARRIER],
    "airline_airport": [CARRIER, "ORIGIN"],
    "route": ["ORIGIN", "DEST"],
    "day": ["FL_DATE"],
}


def report_cube(flights: DataFrame) -> DataFrame:
    """Partials of all these groupings from one scan of the flights, written once."""
    return rate_cube(flights, list(CUBE_SETS.values()), LATE, {"late_minutes": F.when(F.col("ARR_DELAY") > 0, F.col("ARR_DELAY"))})


def reports_from_cube(cube: DataFrame) -> dict[str, DataFrame]:
    """Rate, flights and late minutes of every grouping, read from the cube."""
    return {name: rates_from(cube, keys, sums=["late_minutes"], **NAMES) for name, keys in CUBE_SETS.items()}


def flights_per_year(flights: DataFrame) -> DataFrame:
    return count_by(flights, "YEAR", "num_flights").orderBy("YEAR")


def delay_by_airline(flights: DataFrame) -> DataFrame:
    """Rate per airline with its share of all flights and of all delayed flights, rounded to 2."""
    report = rate_by(flights, CARRIER, LATE, total="num_flights", flagged="num_delayed_flights", rate_col="delay_pct")
    shares = {"num_flights": "pct_total", "num_delayed_flights": "pct_total_delayed"}
    rounded = report.withColumn("delay_pct", F.round("delay_pct", 2))
    return share_of_total(rounded, shares, 2).orderBy(F.desc("num_flights"), CARRIER)


def top_delayed(flights: DataFrame, place: str, k: int = 10) -> DataFrame:
    return top_k(rate_by(flights, place, LATE, **NAMES), "delayed_flights", k, place)


def distance_by_airline(flights: DataFrame) -> DataFrame:
    out = flights.groupBy(CARRIER).agg(F.avg("DISTANCE").alias("avg_distance"), F.count(F.lit(1)).alias("total_flights"))
    return out.orderBy(F.desc("avg_distance"), CARRIER)


def delay_by_quarter(flights: DataFrame) -> DataFrame:
    dated = flights.withColumns({"year": F.year("FL_DATE"), "quarter": F.quarter("FL_DATE")})
    return mean_flag_by(dated, ["year", "quarter", CARRIER], LATE, "delay_pct").withColumn(
        "period", F.format_string("%d Q%d", "year", "quarter")
    )


def best_worst_quarter(flights: DataFrame) -> DataFrame:
    """The quarter and airline with the highest and with the lowest rate, in one aggregate."""
    cells = delay_by_quarter(flights).filter(F.col("delay_pct").isNotNull())
    row = F.struct("year", "quarter", CARRIER, "delay_pct")
    rest = [F.col("year"), F.col("quarter"), F.col(CARRIER)]
    both = cells.agg(
        F.min_by(row, F.struct(-F.col("delay_pct"), *rest)).alias("worst"),
        F.min_by(row, F.struct(F.col("delay_pct"), *rest)).alias("best"),
    )
    ends = F.array(
        F.struct(F.lit("best").alias("which"), F.col("best").alias("cell")),
        F.struct(F.lit("worst").alias("which"), F.col("worst").alias("cell")),
    )
    return both.select(F.inline(ends)).select("which", "cell.*")


def airline_airport_matrix(flights: DataFrame, k: int = 20) -> DataFrame:
    """Rate by airline and airport for the k busiest airports, -1 where an airline does not fly."""
    return rate_matrix(flights, CARRIER, "ORIGIN", busiest(flights, "ORIGIN", k), LATE, -1.0)


def airport_delays(flights: DataFrame, min_total: int = 50) -> DataFrame:
    """Rate and mean positive delay per airport, unknown sizes named so."""
    extra = {"avg_delay_minutes": avg_where("ARR_DELAY", F.col("ARR_DELAY") > 0)}
    keys = ["ORIGIN", "ORIGIN_STATE_ABR", "ORIGIN_SIZE"]
    report = rate_by(flights, keys, LATE, min_total=min_total, extra=extra, **NAMES)
    known = report.filter(F.col("avg_delay_minutes").isNotNull())
    return known.withColumn("airport_size", F.coalesce("ORIGIN_SIZE", F.lit("Unknown")))


def summary_by_size(flights: DataFrame, min_total: int = 50) -> DataFrame:
    return summarise_report(
        airport_delays(flights, min_total),
        "airport_size",
        {
            "num_airports": F.count("ORIGIN"),
            "avg_delay_pct": F.round(F.avg("delay_pct"), 2),
            "avg_delay_minutes": F.round(F.avg("avg_delay_minutes"), 2),
            "total_flights": F.sum("total_flights"),
        },
    )


def busiest_airports(flights: DataFrame, k: int = 15, min_total: int = 50) -> DataFrame:
    return top_k(airport_delays(flights, min_total), "total_flights", k, "ORIGIN", "ORIGIN_STATE_ABR")


COORDS = ["ORIGIN_LAT", "ORIGIN_LONG", "DEST_LAT", "DEST_LON"]


def _domestic(flights: DataFrame) -> DataFrame:
    return where_all(
        flights, F.col("CANCELLED") == 0, F.col("ORIGIN_STATE_ABR").isNotNull(), F.col("DEST_STATE_ABR").isNotNull()
    )


def _route_rates(flights: DataFrame, min_total: int) -> DataFrame:
    """Rate per route with readable coordinates inside the continental box."""
    return _readable(rate_by(flights, ["ORIGIN", "DEST", *COORDS], LATE, min_total=min_total, **NAMES))


def _readable(report: DataFrame) -> DataFrame:
    return in_box(coerce(report, COORDS), "DEST_LAT", "DEST_LON", CONTINENTAL_BOX).dropna()


def routes_from(flights: DataFrame, airport: str, k: int = 20, min_total: int = 50) -> DataFrame:
    """The k worst domestic routes from one airport."""
    own = _domestic(flights).filter(F.col("ORIGIN") == airport)
    return top_k(_route_rates(own, min_total), "delay_pct", k, "DEST")


def worst_routes_of_top_origins(flights: DataFrame, origins: int = 5, routes: int = 12, min_total: int = 50) -> DataFrame:
    """The worst routes of each of the origins with most delayed flights."""
    # One report of all routes, written once: the origins are summed from it, and their routes are picked from it.
    report = stored(rate_by(_domestic(flights), ["ORIGIN", "DEST", *COORDS], LATE, **NAMES), "routes")
    total, delayed = NAMES["total"], NAMES["flagged"]
    late = report.groupBy("ORIGIN", "ORIGIN_LAT", "ORIGIN_LONG").agg(F.sum(delayed).alias("delayed_flights"))
    top = top_k(late, "delayed_flights", origins, "ORIGIN", "ORIGIN_LAT", "ORIGIN_LONG").select("ORIGIN").distinct()
    own = _readable(report.filter(F.col(total) >= min_total)).join(top, "ORIGIN", "left_semi")
    return top_n_per_group(own, "ORIGIN", "delay_pct", routes, "DEST", *COORDS)


def _ends(flights: DataFrame, name: str, origin: dict[str, str], dest: dict[str, str]) -> DataFrame:
    """Every flight as its two ends, so that both roles are counted in one pass. A column of the other role is null."""

    def end(role: str, cols: dict[str, str]) -> Column:
        return F.struct(F.lit(role).alias("role"), *[F.col(c).alias(n) for n, c in cols.items()])

    return flights.select(F.inline(F.array(end("origin", origin), end("dest", dest)))).withColumnRenamed("_name", name)


def city_delays(flights: DataFrame, k: int = 20) -> DataFrame:
    """Cities as origin against as destination, the k with most delays in both roles together."""
    ends = _ends(flights, "city", {"_name": "ORIGIN_CITY_NAME", "late": LATE}, {"_name": "DEST_CITY_NAME", "late": LATE})
    counts = []
    for role in ("origin", "dest"):
        own = F.col("role") == role
        counts += [F.count_if(own).alias(f"{role}_total"), F.coalesce(F.sum(F.when(own, F.col("late").cast("int"))), F.lit(0)).alias(f"{role}_delayed")]
    both = ends.groupBy("city").agg(*counts)
    pct = {f"{r}_delay_pct": F.coalesce(rate(F.col(f"{r}_delayed"), F.col(f"{r}_total")), F.lit(0.0)) for r in ("origin", "dest")}
    summed = both.withColumns(pct).withColumn("total_delayed", F.col("origin_delayed") + F.col("dest_delayed"))
    return top_k(summed, "total_delayed", k, "city")


def delay_contingency(flights: DataFrame) -> DataFrame:
    return contingency(flights, "DEP_DEL15", LATE)


def hour_airline_matrix(flights: DataFrame) -> DataFrame:
    return rate_matrix(flights, CARRIER, "CRS_DEP_HOUR", list(range(24)), LATE, -1.0, prefix="h")


def hour_weekday_matrix(flights: DataFrame) -> DataFrame:
    named = rate_matrix(flights, "CRS_DEP_HOUR", "DAY_OF_WEEK", list(WEEKDAY_NAMES), LATE, 0.0)
    return named.withColumnsRenamed({str(i): n for i, n in WEEKDAY_NAMES.items()})


def by_weekday(flights: DataFrame) -> DataFrame:
    report = rate_by(flights, "DAY_OF_WEEK", LATE, total="total_flights", flagged="delayed_flights", rate_col="delay_rate")
    named = report.withColumn("day_name", label_codes("DAY_OF_WEEK", WEEKDAY_NAMES))
    return named.orderBy(category_rank("day_name", WEEKDAYS))


def by_month(flights: DataFrame) -> DataFrame:
    report = rate_by(flights, "MONTH", LATE, total="total_flights", flagged="delayed_flights", rate_col="delay_rate")
    return report.withColumn("month_name", label_codes("MONTH", MONTH_NAMES)).orderBy("MONTH")


def daily_series(flights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rate_by(
        flights, [*by, "FL_DATE"], LATE, total="total_flights", flagged="delayed_flights", rate_col="delay_rate"
    )


def monthly_series(flights: DataFrame) -> DataFrame:
    """Mean of the daily rates of each month."""
    return resample(daily_series(flights), "FL_DATE", "month", "delay_rate")


def status_by_day(flights: DataFrame) -> DataFrame:
    named = flights.withColumn("flight_status", status_label("CANCELLED", LATE))
    return count_by(named, ["DAY_OF_MONTH", "flight_status"], "num_flights").orderBy("DAY_OF_MONTH", "flight_status")


def _any_set(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c)
    return total > 0


def precipitation_effect(flights: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rate with and without any of the precipitation flags."""
    marked = flights.withColumn("ANY_PRECIP", _any_set(flags))
    return mean_flag_by(marked, "ANY_PRECIP", LATE, "pct_delayed").orderBy("ANY_PRECIP")


def _binned(flights: DataFrame, value: str, alias: str, bins: tuple, null_label: str | None) -> DataFrame:
    uppers, last = bins
    binned = flights.withColumn(alias, bin_label(value, uppers, last, null_label))
    order = [n for _, n in uppers] + [last]
    return mean_flag_by(binned, alias, LATE, "pct_delayed").orderBy(category_rank(alias, order))


def ceiling_effect(flights: DataFrame, ceiling: str = "ceiling_ft", null_label: str | None = None) -> DataFrame:
    return _binned(flights, ceiling, "CEILING_BIN", CEILING_BINS, null_label)


def wind_bins(flights: DataFrame, null_label: str | None = None) -> DataFrame:
    """Rate by wind bin; nulls count as the top bin unless given a label of their own."""
    return _binned(flights, "HourlyWindSpeed", "WIND_BIN", WIND_BINS, null_label)


def station_precipitation(flights: DataFrame, min_total: int = 50) -> DataFrame:
    """Mean precipitation and share of wet observations per origin and station."""
    amount = F.coalesce(F.col("HourlyPrecipitation").try_cast("double"), F.lit(0.0))
    wet = flights.filter(F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull()).withColumns(
        {"precip_amt": amount, "precip_flag": F.when(amount > 0, 1).otherwise(0)}
    )
    return rate_by(
        wet,
        ["ORIGIN", "NAME", "LATITUDE", "LONGITUDE"],
        "precip_flag",
        min_total=min_total,
        total="obs_count",
        flagged="n_precip",
        rate_col="pct_precip",
        extra={"avg_precip": F.avg("precip_amt")},
    )


def wind_vs_delay(flights: DataFrame, cap: float = 60.0) -> DataFrame:
    """Mean wind and delay percentage per airport, the percentage clipped."""
    keys = ["ORIGIN", "ORIGIN_SIZE"]
    means = mean_by(flights, keys, {"HourlyWindSpeed": "avg_wind_speed", LATE: "delay_rate"})
    known = means.dropna(subset=["avg_wind_speed", "delay_rate", "ORIGIN_SIZE"])
    return known.withColumn("delay_rate", F.least(F.col("delay_rate") * 100, F.lit(cap)))


def wind_by_hour(flights: DataFrame) -> DataFrame:
    timed = flights.withColumn("DEP_HOUR", F.floor(F.col("CRS_DEP_TIME") / 100).cast("int"))
    return mean_by(timed, "DEP_HOUR", {"HourlyWindSpeed": "avg_wind_speed"}).orderBy("DEP_HOUR")


def wind_by_month(flights: DataFrame) -> DataFrame:
    return mean_by(flights, "MONTH", {"HourlyWindSpeed": "avg_wind_speed"}).orderBy("MONTH")


def cause_combos(flights: DataFrame) -> DataFrame:
    """Flights per exclusive combination of delay causes, with a short number label."""
    marked = flights.select(cause_combo(CAUSE_COLUMNS).alias("delay_combo")).filter(F.col("delay_combo") != "")
    counts = count_by(marked, "delay_combo", "num_flights")
    return counts.withColumn("num_flights_label", thousands_label("num_flights")).orderBy(
        F.desc("num_flights"), "delay_combo"
    )


def top_routes_per_cause(flights: DataFrame, n: int = 10) -> DataFrame:
    routes = explode_causes(flights.withColumn("route", route_label("ORIGIN", "DEST")), CAUSE_COLUMNS, "cause")
    counts = count_by(routes, ["route", "cause"], "num_delayed_flights")
    return top_n_per_group(counts, "cause", "num_delayed_flights", n, "route")


def cause_totals(flights: DataFrame, n: int = 10) -> DataFrame:
    return top_routes_per_cause(flights, n).groupBy("cause").agg(F.sum("num_delayed_flights").alias("total_count"))


def cause_route_totals(flights: DataFrame) -> DataFrame:
    """Delayed flights per route over the ten routes of every cause."""
    return top_routes_per_cause(flights).groupBy("route").agg(F.sum("num_delayed_flights").alias("total_count"))


def popular_routes(flights: DataFrame, k: int = 10) -> DataFrame:
    return top_k(count_by(flights, ["ORIGIN", "DEST"], "num_flights"), "num_flights", k, "ORIGIN", "DEST")


def top_destinations(flights: DataFrame, origins: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent destinations of the given origins."""
    routes = count_by(flights, ["ORIGIN", "DEST"], "num_flights")
    own = routes.join(origins.select("ORIGIN").distinct(), "ORIGIN", "left_semi")
    return top_n_per_group(own, "ORIGIN", "num_flights", n, "DEST")


def airport_importance(flights: DataFrame) -> DataFrame:
    """Mean rank and summed degree of every airport, as origin and as destination."""
    ends = _ends(
        flights,
        "Airport",
        {"_name": "ORIGIN", "rank": "origin_pagerank", "degree": "origin_out_degree"},
        {"_name": "DEST", "rank": "dest_pagerank", "degree": "dest_in_degree"},
    )
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    return ends.groupBy("Airport").agg(
        F.avg(of("origin", "rank")).alias("origin_pagerank"),
        F.sum(of("origin", "degree")).alias("OutDegree"),
        F.avg(of("dest", "rank")).alias("dest_pagerank"),
        F.sum(of("dest", "degree")).alias("InDegree"),
    )


def label_balance(flights: DataFrame) -> DataFrame:
    return count_by(flights, LATE, "n_rows").orderBy(LATE)


def arrival_delay_histogram(flights: DataFrame, bins: int = 60, longest: float = 300) -> DataFrame:
    """Distribution of the delay of delayed flights, over all of them."""
    delayed = where_all(
        flights,
        F.col("CANCELLED") == 0,
        F.col(LATE) == 1,
        F.col("ARR_DELAY").isNotNull(),
        F.col("ARR_DELAY") <= longest,
    )
    return histogram(delayed, "ARR_DELAY", bins)

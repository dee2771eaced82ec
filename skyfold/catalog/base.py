"""Registration and the flight-like view derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, legs: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function name; ``legs`` puts the flight view in front of the SQL."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_legs(sql) if legs else sql
        return fn

    return register


def with_legs(sql: str) -> str:
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {LEGS_SQL}, {body[5:]}"
    return f"WITH {LEGS_SQL} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded so that the order of summation cannot show."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _hhmm(minute: Column) -> Column:
    return (F.floor(minute / 60) * 100 + minute % 60).cast("int")


def legs(
    spark: SparkSession, sf_dir: str, carrier: bool = True, origin: bool = True, dest: bool = True
) -> DataFrame:
    """A flight-like view of the order tables: each line item is one leg.

    Suppliers' nations are origins, customers' nations destinations, order priorities carriers,
    suppliers vehicles. Only the joins a query needs are made.
    """
    df = table(spark, sf_dir, "lineitem").withColumns(
        {
            "_q": F.col("l_quantity").cast("int"),
            "_tax": F.round(F.col("l_tax") * 100).cast("int"),
            "_m": ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 211 + F.col("l_orderkey")) % 1440).cast("int"),
        }
    )
    df = df.withColumns(
        {
            "FL_DATE": F.to_date("l_shipdate"),
            "YEAR": F.year("l_shipdate"),
            "QUARTER": F.quarter("l_shipdate"),
            "MONTH": F.month("l_shipdate"),
            "DAY_OF_MONTH": F.dayofmonth("l_shipdate"),
            "DAY_OF_WEEK": F.weekday("l_shipdate") + 1,
            "TAIL_NUM": F.concat(F.lit("T"), F.col("l_suppkey").cast("string")),
            "OP_CARRIER_FL_NUM": F.col("l_partkey").cast("string"),
            "CANCELLED": (F.col("_tax") == 8).cast("int"),
            "DIVERTED": ((F.col("_tax") == 7) & (F.col("l_linenumber") == 7)).cast("int"),
            "ARR_DELAY": (F.col("_q") * 2 - 60).cast("double"),
            "DEP_DELAY": ((F.col("_q") * 7) % 50 * 2 - 40).cast("double"),
            "CRS_ELAPSED_TIME": (60 + F.col("l_partkey") % 300).cast("double"),
            "DISTANCE": (100 + F.col("l_partkey") % 2400).cast("double"),
            "CRS_DEP_TIME": _hhmm(F.col("_m")),
            "CRS_DEP_HOUR": F.floor(F.col("_m") / 60).cast("int"),
            "HourlyWindSpeed": F.when(F.col("l_linenumber") < 7, F.col("_q") * 3 % 31).cast("int"),
            "HourlyPrecipitation": F.when(F.col("_tax") == 1, F.lit("T")).when(
                F.col("_tax") < 4, F.col("_tax").cast("string")
            ),
        }
    )
    late = F.when(F.col("CANCELLED") == 0, (F.col("ARR_DELAY") >= 15).cast("int"))
    df = df.withColumns(
        {
            "ARR_DEL15": late,
            "DEP_DEL15": F.when(F.col("CANCELLED") == 0, (F.col("DEP_DELAY") >= 15).cast("int")),
            "ACTUAL_ELAPSED_TIME": F.col("CRS_ELAPSED_TIME") + F.col("ARR_DELAY") - F.col("DEP_DELAY"),
            "CARRIER_DELAY": F.when((late == 1) & (F.col("l_linenumber") % 2 == 0), F.col("ARR_DELAY")),
            "WEATHER_DELAY": F.when((late == 1) & (F.col("l_suppkey") % 5 == 0), F.col("ARR_DELAY")),
            "NAS_DELAY": F.when((late == 1) & (F.col("l_partkey") % 3 == 0), F.col("ARR_DELAY")),
            "SECURITY_DELAY": F.when((late == 1) & (F.col("l_partkey") % 50 == 0), F.col("ARR_DELAY")),
            "LATE_AIRCRAFT_DELAY": F.when((late == 1) & (F.col("l_linenumber") % 3 == 0), F.lit(0.0)),
        }
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    if carrier or dest:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed(
            "o_orderpriority", "OP_UNIQUE_CARRIER"
        )
    if origin:
        key = F.col("n_nationkey")
        side = nation.select(
            key.alias("_onk"),
            F.col("n_name").alias("ORIGIN"),
            F.col("r_name").alias("ORIGIN_STATE_ABR"),
            F.concat(F.lit("City "), key).alias("ORIGIN_CITY_NAME"),
            (24 + key).cast("string").alias("ORIGIN_LAT"),
            (key * 3 - 130).cast("string").alias("ORIGIN_LONG"),
            F.when(key % 4 == 0, F.lit("large_airport")).when(key % 4 == 1, F.lit("medium_airport")).when(
                key % 4 == 2, F.lit("small_airport")
            ).alias("ORIGIN_SIZE"),
        )
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        airports = supplier.join(side, F.col("s_nationkey") == F.col("_onk"))
        df = df.join(airports, F.col("l_suppkey") == F.col("s_suppkey"))
    if dest:
        key = F.col("n_nationkey")
        side = nation.select(
            key.alias("_dnk"),
            F.col("n_name").alias("DEST"),
            F.col("r_name").alias("DEST_STATE_ABR"),
            F.concat(F.lit("City "), key + 5).alias("DEST_CITY_NAME"),
            F.when(key == 3, F.lit("unknown")).otherwise((20 + key).cast("string")).alias("DEST_LAT"),
            (key * 3 - 130).cast("string").alias("DEST_LON"),
        )
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        places = customer.join(side, F.col("c_nationkey") == F.col("_dnk"))
        df = df.join(places, F.col("o_custkey") == F.col("c_custkey"))
    return df


LEGS_SQL = """legs0 AS (
  SELECT *, CAST(l_quantity AS INTEGER) AS q_, CAST(round(l_tax * 100) AS INTEGER) AS tax_,
         CAST((l_partkey * 37 + l_linenumber * 211 + l_orderkey) % 1440 AS INTEGER) AS m_
  FROM lineitem
), legs1 AS (
  SELECT *,
    CAST(l_shipdate AS DATE) AS "FL_DATE",
    CAST(year(l_shipdate) AS INTEGER) AS "YEAR",
    CAST(quarter(l_shipdate) AS INTEGER) AS "QUARTER",
    CAST(month(l_shipdate) AS INTEGER) AS "MONTH",
    CAST(day(l_shipdate) AS INTEGER) AS "DAY_OF_MONTH",
    CAST(isodow(l_shipdate) AS INTEGER) AS "DAY_OF_WEEK",
    'T' || l_suppkey AS "TAIL_NUM",
    CAST(l_partkey AS VARCHAR) AS "OP_CARRIER_FL_NUM",
    CAST(tax_ = 8 AS INTEGER) AS "CANCELLED",
    CAST(tax_ = 7 AND l_linenumber = 7 AS INTEGER) AS "DIVERTED",
    CAST(q_ * 2 - 60 AS DOUBLE) AS "ARR_DELAY",
    CAST((q_ * 7) % 50 * 2 - 40 AS DOUBLE) AS "DEP_DELAY",
    CAST(60 + l_partkey % 300 AS DOUBLE) AS "CRS_ELAPSED_TIME",
    CAST(100 + l_partkey % 2400 AS DOUBLE) AS "DISTANCE",
    CAST(m_ // 60 * 100 + m_ % 60 AS INTEGER) AS "CRS_DEP_TIME",
    CAST(m_ // 60 AS INTEGER) AS "CRS_DEP_HOUR",
    CAST(CASE WHEN l_linenumber < 7 THEN q_ * 3 % 31 END AS INTEGER) AS "HourlyWindSpeed",
    CASE WHEN tax_ = 1 THEN 'T' WHEN tax_ < 4 THEN CAST(tax_ AS VARCHAR) END AS "HourlyPrecipitation"
  FROM legs0
), legs2 AS (
  SELECT *,
    CASE WHEN "CANCELLED" = 0 THEN CAST("ARR_DELAY" >= 15 AS INTEGER) END AS "ARR_DEL15",
    CASE WHEN "CANCELLED" = 0 THEN CAST("DEP_DELAY" >= 15 AS INTEGER) END AS "DEP_DEL15",
    "CRS_ELAPSED_TIME" + "ARR_DELAY" - "DEP_DELAY" AS "ACTUAL_ELAPSED_TIME"
  FROM legs1
), legs AS (
  SELECT l.*,
    CASE WHEN "ARR_DEL15" = 1 AND l_linenumber % 2 = 0 THEN "ARR_DELAY" END AS "CARRIER_DELAY",
    CASE WHEN "ARR_DEL15" = 1 AND l_suppkey % 5 = 0 THEN "ARR_DELAY" END AS "WEATHER_DELAY",
    CASE WHEN "ARR_DEL15" = 1 AND l_partkey % 3 = 0 THEN "ARR_DELAY" END AS "NAS_DELAY",
    CASE WHEN "ARR_DEL15" = 1 AND l_partkey % 50 = 0 THEN "ARR_DELAY" END AS "SECURITY_DELAY",
    CASE WHEN "ARR_DEL15" = 1 AND l_linenumber % 3 = 0 THEN CAST(0 AS DOUBLE) END AS "LATE_AIRCRAFT_DELAY",
    o_orderpriority AS "OP_UNIQUE_CARRIER",
    a.n_name AS "ORIGIN", ar.r_name AS "ORIGIN_STATE_ABR", 'City ' || a.n_nationkey AS "ORIGIN_CITY_NAME",
    CAST(24 + a.n_nationkey AS VARCHAR) AS "ORIGIN_LAT", CAST(a.n_nationkey * 3 - 130 AS VARCHAR) AS "ORIGIN_LONG",
    CASE a.n_nationkey % 4 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' WHEN 2 THEN 'small_airport' END
      AS "ORIGIN_SIZE",
    b.n_name AS "DEST", br.r_name AS "DEST_STATE_ABR", 'City ' || (b.n_nationkey + 5) AS "DEST_CITY_NAME",
    CASE WHEN b.n_nationkey = 3 THEN 'unknown' ELSE CAST(20 + b.n_nationkey AS VARCHAR) END AS "DEST_LAT",
    CAST(b.n_nationkey * 3 - 130 AS VARCHAR) AS "DEST_LON"
  FROM legs2 l
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN region ar ON a.n_regionkey = ar.r_regionkey
  JOIN nation b ON c_nationkey = b.n_nationkey JOIN region br ON b.n_regionkey = br.r_regionkey
)"""

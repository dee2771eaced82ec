"""Queries for scans, sinks, filters, joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.catalog.base import legs, query, table
from skyfold.functions.clock import ntz
from skyfold.functions.labels import composite_id, label_codes, order_by_category, split_coordinates
from skyfold.operators import relational as R
from skyfold.operators.quality import wide_to_long
from skyfold.operators.reports import count_by
from skyfold.session import scratch_path
from skyfold.sources import tables as S

# ---------------------------------------------------------------- scans and sinks


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string"
    return S.read_parquet(spark, f"{sf}/orders.parquet", spark.createDataFrame([], schema).schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers written as CSV with a header and read back under a stated schema."""
    supplier = table(spark, sf, "supplier")
    path = scratch_path(spark, "csv")
    supplier.write.option("header", True).csv(path)
    return S.read_csv(spark, path, supplier.schema)


@query("SELECT p_partkey, p_brand, p_size FROM part")
def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    S.write_table(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), path)
    return S.read_parquet(spark, path)


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
def keyed_layout_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders laid out by date and priority, read back whole."""
    path = scratch_path(spark, "keyed")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    S.write_table(orders, path, n_files=100, keys=["o_orderdate", "o_orderpriority"])
    return S.read_parquet(spark, path)


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth,
      c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def bucketed_join_window(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and customers written in buckets by customer, then joined and numbered without shuffling either."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    orders = S.write_bucketed(orders, scratch_path(spark, "orders"), ["o_custkey"], sort=["o_custkey", "o_orderkey"])
    customers = S.write_bucketed(customers, scratch_path(spark, "customers"), ["c_custkey"])
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return orders.withColumn("nth", nth).join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def split_partition_read(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of a hold-out in one partitioned table, one side read back by pruning."""
    orders = table(spark, sf, "orders")
    early = F.col("o_orderdate") < ntz("1999-01-01")
    path = scratch_path(spark, "splits")
    S.write_splits(orders.filter(early), orders.filter(~early), path)
    return S.read_split(spark, path, "train").select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- filters and projections


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-01-01'")
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends count: midnight of the last day is kept."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return orders.filter(F.col("o_orderdate").between(ntz("1996-01-01"), ntz("1998-01-01")))


@query(
    """SELECT l_orderkey, l_linenumber, "FL_DATE", "ORIGIN", "DEST" FROM legs
    WHERE "CANCELLED" = 0 AND "DIVERTED" = 0
      AND "ORIGIN" NOT IN ('NATION_3', 'NATION_7') AND "DEST" NOT IN ('NATION_3', 'NATION_7')""",
    legs=True,
)
def operated_legs(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.operated_only(
        legs(spark, sf), ["CANCELLED", "DIVERTED"], ["ORIGIN", "DEST"], ["NATION_3", "NATION_7"]
    )
    return kept.select("l_orderkey", "l_linenumber", "FL_DATE", "ORIGIN", "DEST")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def substring_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.contains(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "ring")


@query(
    """SELECT c_custkey, c_name, c_nationkey FROM customer
    WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IS NOT NULL AND c_name IS NOT NULL"""
)
def dimension_filter(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    kept = R.dim_filter(customer, {"c_mktsegment": "MACHINERY"}, ["c_nationkey", "c_name"])
    return kept.select("c_custkey", "c_name", "c_nationkey")


@query("SELECT p_partkey, p_brand FROM part WHERE length(p_brand) = 7")
def code_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.code_length(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 7)


@query("SELECT n_nationkey AS ORIGIN_KEY, n_name AS ORIGIN_NAME FROM nation")
def renamed_projection(spark: SparkSession, sf: str) -> DataFrame:
    return R.prefix_columns(table(spark, sf, "nation"), {"n_nationkey": "ORIGIN_KEY", "n_name": "ORIGIN_NAME"})


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return R.drop_matching(table(spark, sf, "customer"), suffixes=["_nationkey", "segment"], names=["c_name"])


@query(
    """SELECT l_orderkey, l_partkey, "ARR_DELAY" FROM legs
    WHERE "CANCELLED" = 0 AND "ARR_DEL15" = 1 AND "ARR_DELAY" IS NOT NULL AND "ARR_DELAY" <= 30""",
    legs=True,
)
def chained_filters(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.where_all(
        legs(spark, sf, carrier=False, origin=False, dest=False),
        F.col("CANCELLED") == 0,
        "ARR_DEL15 = 1",
        F.col("ARR_DELAY").isNotNull(),
        "ARR_DELAY <= 30",
    )
    return kept.select("l_orderkey", "l_partkey", "ARR_DELAY")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "DEST" FROM legs
    WHERE TRY_CAST("DEST_LAT" AS DOUBLE) BETWEEN 24 AND 50 AND TRY_CAST("DEST_LON" AS DOUBLE) BETWEEN -125 AND -65""",
    legs=True,
)
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.in_box(legs(spark, sf, origin=False), "DEST_LAT", "DEST_LON", (24, 50, -125, -65))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "DEST")


@query(
    """SELECT l_orderkey, l_partkey, TRY_CAST("HourlyPrecipitation" AS DOUBLE) AS "HourlyPrecipitation" FROM legs
    WHERE TRY_CAST("HourlyPrecipitation" AS DOUBLE) IS NOT NULL""",
    legs=True,
)
def numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return R.coerce(df, ["HourlyPrecipitation"]).select("l_orderkey", "l_partkey", "HourlyPrecipitation")


@query(
    """SELECT l_orderkey, l_partkey, "HourlyWindSpeed" FROM legs
    WHERE "HourlyWindSpeed" IS NOT NULL AND "ARR_DEL15" IS NOT NULL""",
    legs=True,
)
def null_row_removal(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return df.dropna(subset=["HourlyWindSpeed", "ARR_DEL15"]).select("l_orderkey", "l_partkey", "HourlyWindSpeed")


_CAUSES = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY"]


@query(
    """SELECT 'any' AS test, count(*) AS n FROM legs
    WHERE "CARRIER_DELAY" IS NULL OR "WEATHER_DELAY" IS NULL OR "NAS_DELAY" IS NULL
    UNION ALL SELECT 'all', count(*) FROM legs
    WHERE "CARRIER_DELAY" IS NULL AND "WEATHER_DELAY" IS NULL AND "NAS_DELAY" IS NULL""",
    legs=True,
)
def null_tests(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False).select(*_CAUSES)
    parts = {"any": R.any_null(df, _CAUSES), "all": R.all_null(df, _CAUSES)}
    return count_by(R.tagged_union(parts, "test"), "test")


@query("""SELECT l_orderkey, l_partkey FROM legs WHERE "ARR_DEL15" = 0 AND "DEP_DELAY" > 20""", legs=True)
def sql_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return R.where_all(df, "ARR_DEL15 = 0 AND DEP_DELAY > 20").select("l_orderkey", "l_partkey")


# ---------------------------------------------------------------- joins


@query(
    """SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey = 2"""
)
def dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    nation = R.dim_filter(table(spark, sf, "nation"), {"n_regionkey": 2})
    return R.dim_join(table(spark, sf, "supplier"), nation, "s_nationkey", "n_nationkey").select(
        "s_suppkey", "s_name", "n_name"
    )


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    used = R.keep_used(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")
    return used.select("c_custkey", "c_name")


@query(
    """SELECT o_orderkey, c.n_name AS DEST_NATION, r.r_name AS DEST_REGION FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation c ON c_nationkey = c.n_nationkey
    LEFT JOIN region r ON c.n_regionkey = r.r_regionkey"""
)
def role_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension attached in one role: the customer's place as the destination of an order."""
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    place = R.role_join(table(spark, sf, "customer"), nation, "n_nationkey", "c_nationkey",
                        {"n_name": "DEST_NATION", "r_name": "DEST_REGION"})
    names = {"DEST_NATION": "DEST_NATION", "DEST_REGION": "DEST_REGION"}
    return R.role_join(table(spark, sf, "orders"), place, "c_custkey", "o_custkey", names).select(
        "o_orderkey", "DEST_NATION", "DEST_REGION"
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.n_name AS ORIGIN_NAME, b.n_name AS DEST_NAME
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey"""
)
def role_playing_dims(spark: SparkSession, sf: str) -> DataFrame:
    """The same dimension in two roles."""
    nation = table(spark, sf, "nation")
    fact = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    fact = R.role_join(fact, table(spark, sf, "supplier"), "s_suppkey", "l_suppkey", {"s_nationkey": "from_key"})
    fact = R.role_join(fact, table(spark, sf, "customer"), "c_custkey", "o_custkey", {"c_nationkey": "to_key"})
    fact = R.role_join(fact, nation, "n_nationkey", "from_key", {"n_name": "ORIGIN_NAME"})
    return R.role_join(fact, nation, "n_nationkey", "to_key", {"n_name": "DEST_NAME"}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ORIGIN_NAME", "DEST_NAME"
    )


@query(
    """SELECT o_orderkey,
      coalesce(CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment END, 'from part') AS segment,
      coalesce(CASE WHEN c_nationkey % 3 > 0 AND c_acctbal > 0 THEN c_acctbal END, p_retailprice) AS amount
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON o_custkey = p_partkey"""
)
def fallback_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Columns from a primary dimension with gaps, backed up by a second dimension."""
    covered = F.col("c_nationkey") % 3 > 0
    primary = table(spark, sf, "customer").filter(covered).select(
        F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("amount"),
    )
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("amount"))
    backup = customers.join(parts, "key", "left").withColumn("segment", F.lit("from part"))
    names = {"segment": "segment", "amount": "amount"}
    return R.fallback_join(table(spark, sf, "orders"), primary, backup, "key", "o_custkey", names).select(
        "o_orderkey", "segment", "amount"
    )


@query(
    """WITH a AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
    b AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal < -900 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS nation_key, coalesce(n_suppliers, 0) AS n_suppliers,
      coalesce(n_customers, 0) AS n_customers FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    rich = count_by(table(spark, sf, "supplier").filter("s_acctbal > 5000"), "s_nationkey", "n_suppliers")
    poor = count_by(table(spark, sf, "customer").filter("c_acctbal < -900"), "c_nationkey", "n_customers")
    return R.outer_merge(
        rich.withColumnRenamed("s_nationkey", "nation_key"), poor.withColumnRenamed("c_nationkey", "nation_key"),
        "nation_key",
    )


@query(
    """SELECT n_nationkey, n_name, arg_min(s_name, s_suppkey) AS first_supplier FROM nation
    LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""
)
def first_row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = {"s_name": "first_supplier"}
    out = R.lookup_first(
        table(spark, sf, "nation"), table(spark, sf, "supplier"), "n_nationkey", "s_nationkey", names, "s_suppkey"
    )
    return out.select("n_nationkey", "n_name", "first_supplier")


@query(
    """SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END
      AS line_name FROM lineitem"""
)
def code_labels(spark: SparkSession, sf: str) -> DataFrame:
    named = label_codes("l_linenumber", {1: "one", 2: "two", 3: "three"}).alias("line_name")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", named)


@query(
    """SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey, min(s_acctbal) AS s_acctbal
    FROM supplier GROUP BY s_nationkey"""
)
def nearest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return R.nearest_per_key(supplier, "s_nationkey", "s_acctbal", "s_suppkey")


# ---------------------------------------------------------------- set operations, sorts, limits


@query(
    """SELECT 'customer' AS tag, c_nationkey AS nation_key, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier"""
)
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    sides = {
        n: table(spark, sf, n).select(F.col(f"{n[0]}_nationkey").alias("nation_key"), F.col(f"{n[0]}_acctbal").alias("balance"))
        for n in ("customer", "supplier")
    }
    return R.tagged_union(sides)


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    """SELECT DISTINCT * FROM (SELECT "ORIGIN" AS place, 'Origin' AS role FROM legs
    UNION ALL SELECT "DEST", 'Dest' FROM legs)""",
    legs=True,
)
def distinct_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Places with their roles, duplicates removed on each side before they meet."""
    df = legs(spark, sf, carrier=False)
    sides = {r: df.select(F.col(r.upper()).alias("place")).distinct() for r in ("Origin", "Dest")}
    return R.tagged_union(sides, "role")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_k_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, "c_custkey")


@query(
    """SELECT * FROM (SELECT p_partkey, p_retailprice, 'max' AS which FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)
    UNION ALL SELECT * FROM (SELECT p_partkey, p_retailprice, 'min' FROM part ORDER BY p_retailprice, p_partkey LIMIT 1)"""
)
def extreme_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return R.tagged_union({k: R.arg_extreme(part, "p_retailprice", k, "p_partkey") for k in ("max", "min")}, "which")


@query(
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1
    ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderpriority"""
)
def category_order(spark: SparkSession, sf: str) -> DataFrame:
    counts = count_by(table(spark, sf, "orders"), "o_orderpriority")
    return order_by_category(counts, "o_orderpriority", ["5-LOW", "1-URGENT"], "o_orderpriority")


@query("SELECT o_custkey, o_totalprice, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return orders.orderBy("o_custkey", F.desc("o_totalprice"), "o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 7)")
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.preview(table(spark, sf, "orders"), 7).agg(F.count(F.lit(1)).alias("n"))


@query(
    """UNPIVOT (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)
    ON l_quantity, l_extendedprice INTO NAME measure VALUE amount"""
)
def wide_to_long_rows(spark: SparkSession, sf: str) -> DataFrame:
    ids = ["l_orderkey", "l_partkey", "l_suppkey"]
    df = table(spark, sf, "lineitem").select(*ids, "l_quantity", "l_extendedprice")
    return wide_to_long(df, ids, ["l_quantity", "l_extendedprice"], "measure", "amount")


@query(
    """SELECT event_id, concat_ws('_', CAST(user_id AS VARCHAR), event_type,
      CASE WHEN value > 100 THEN lpad(CAST(CAST(floor(value) AS INTEGER) AS VARCHAR), 4, '0') END) AS composite
    FROM events"""
)
def composite_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Null parts are left out of the id."""
    padded = F.when(F.col("value") > 100, F.lpad(F.floor("value").cast("int").cast("string"), 4, "0"))
    return table(spark, sf, "events").select("event_id", composite_id("user_id", "event_type", padded).alias("composite"))


@query(
    """SELECT "ORIGIN_LAT" || ',' || "ORIGIN_LONG" AS coordinates, "ORIGIN_LAT" AS lat, "ORIGIN_LONG" AS lon,
      count(*) AS n FROM legs GROUP BY 1, 2, 3""",
    legs=True,
)
def coordinate_split(spark: SparkSession, sf: str) -> DataFrame:
    joined = legs(spark, sf, carrier=False, dest=False).select(
        F.concat_ws(",", "ORIGIN_LAT", "ORIGIN_LONG").alias("coordinates")
    )
    lat, lon = split_coordinates("coordinates")
    return count_by(joined.withColumns({"lat": lat, "lon": lon}), ["coordinates", "lat", "lon"])


from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyfold.operators import quality as Q
from skyfold.operators import relational as R
from skyfold.sources import tables as S
from skyfold.sources.schemas import AIRPORT_CODES
from tests.conftest import rows


def test_data_set_sizes():
    assert [S.data_set(k) for k in (3, 6, 12, "all")] == ["_3m", "_6m", "_1y", ""]
    with pytest.raises(ValueError, match="unknown data set size"):
        S.data_set(5)


def test_csv_with_stated_schema(spark, tmp_path):
    names = AIRPORT_CODES.names
    text = ",".join(names) + "\n" + ",".join(["K1", "small", "x", "12.5", "NA", "US", "US-TX", "y", "KABC", "ABC", "ABC", '"1,2"']) + "\n"
    (tmp_path / "a.csv").write_text(text)
    r = S.read_csv(spark, str(tmp_path / "a.csv"), AIRPORT_CODES).first()
    assert (r["elevation_ft"], r["iata_code"], r["coordinates"]) == (12.5, "ABC", "1,2")


def test_split_sink(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    S.write_splits(df.filter("id < 7"), df.filter("id >= 7"), str(tmp_path / "s"))
    assert S.read_split(spark, str(tmp_path / "s"), "test").count() == 3
    plan = S.read_split(spark, str(tmp_path / "s"), "test")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_dates_and_operated(spark):
    data = [("2015-01-01", 0, 0, "A", "B"), ("2020-01-01", 0, 0, "A", "B"), ("2020-01-02", 0, 0, "A", "B"),
            ("2016-01-01", 1, 0, "A", "B"), ("2016-01-01", 0, 1, "A", "B"), ("2016-01-01", 0, 0, "GUM", "B"),
            ("2016-01-01", 0, 0, "A", "GUM"), ("2016-01-01", None, 0, "A", "B")]
    df = spark.createDataFrame(data, "d string, c int, v int, o string, t string")
    kept = R.operated_only(R.date_between(df, "d", "2015-01-01", "2020-01-01"), ["c", "v"], ["o", "t"], ["GUM"])
    assert [r[0] for r in rows(kept)] == ["2015-01-01", "2020-01-01"]


def test_null_safe_boxes_and_casts(spark):
    df = spark.createDataFrame([("30", "-100"), ("x", "-100"), (None, "-100"), ("51", "-100")], "a string, o string")
    assert R.in_box(df, "a", "o", (24, 50, -125, -65)).count() == 1
    assert R.coerce(df, ["a"]).count() == 2 and R.coerce(df, ["a"], drop_bad=False).count() == 4
    assert dict(R.enforce_types(df, {"a": "int", "zz": "int"}).dtypes)["a"] == "int"
    assert R.any_null(df, ["a", "o"]).count() == 1 and R.all_null(df, ["a", "o"]).count() == 0


def test_fallback_per_column(spark):
    fact = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    primary = spark.createDataFrame([("a", 1, None, "s1"), ("b", None, 2, "s2")], "key string, x int, y int, station string")
    backup = spark.createDataFrame([("a", 9, 9), ("b", 8, 8), ("c", 7, None)], "key string, x int, y int")
    out = R.fallback_join(fact, primary, backup, "key", "k", {"x": "X", "y": "Y", "station": "S"})
    assert rows(out) == sorted([("a", 1, 9, "s1"), ("b", 8, 2, "s2"), ("c", 7, None, None), (None, None, None, None)], key=repr)


def test_nearest_and_lookup(spark):
    df = spark.createDataFrame([("a", 2.0, "z"), ("a", 1.0, "y"), ("a", 1.0, "x"), ("b", None, "q")], "k string, d double, s string")
    assert rows(R.nearest_per_key(df, "k", "d", "s")) == [("a", 1.0, "x"), ("b", None, "q")]
    keys = spark.createDataFrame([("a",), ("n",)], "k string")
    assert rows(R.lookup_first(keys, df, "k", "k", {"s": "first"}, "s")) == [("a", "x"), ("n", None)]


def test_schema_diff_and_alignment(spark):
    a = spark.createDataFrame([], "x int, y string")
    b = spark.createDataFrame([], "y string, z double")
    assert rows(R.schema_diff(a, b)) == [
        ("x", "int", None, "left_only"), ("y", "string", "string", "both"), ("z", None, "double", "right_only")]
    assert rows(Q.align_columns({"a": a, "b": b})) == [("x", ["b"]), ("y", []), ("z", ["a"])]


def test_edges_within_and_extremes(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "a", 3)], "src string, dst string, weight int")
    n = spark.createDataFrame([("a",), ("b",)], "node string")
    assert rows(R.edges_within(e, n, "src", "dst")) == [("a", "b", 1), ("b", "a", 3)]
    assert R.arg_extreme(e, "weight", "max").first()["weight"] == 3
    assert R.drop_matching(e, suffixes=["t"], names=["src"]).columns == []


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "x", None), (None, None, None)], "i int, s string, a array<int>")
    got = {r["column_name"]: (r["data_type"], r["null_count"]) for r in Q.null_profile(df).collect()}
    assert got == {"i": ("Integer", 1), "s": ("String", 2), "a": ("Array[Integer]", 2)}
    sk = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (10.0, 5.0)], "x double, c double")
    skew = {r[0]: r[1] for r in Q.skew_profile(sk, ["x", "c"]).collect()}
    assert abs(skew["x"] - 0.6746) < 1e-4 and skew["c"] is None
    dup = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert Q.duplicate_rows(dup).first().asDict() == {"total_rows": 3, "distinct_rows": 2, "duplicate_rows": 1}
    assert [r[1] for r in Q.distinct_counts(dup, ["x"], rsd=0.05).collect()] == [2]


def test_literal_rows_and_fold_ids(spark):
    df = S.literal_rows(spark, [(1, "a"), (1, "b"), (2, "c")], "fold int, name string")
    assert rows(S.fold_ids(df)) == [(1,), (2,)]

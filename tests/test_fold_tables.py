"""The folds of the forest queries are worked out once, whatever their number."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyfold.catalog import modelling
from skyfold.operators import splits as SP


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Order tables of 400 lines over six years."""
    at = tmp_path_factory.mktemp("tables")
    line = [(i % 40, i * 7 % 90, i % 5, i % 7 + 1, float(i % 50 + 1), 100.0, 0.0, (i % 9) / 100, dt.datetime(1992, 1, 1) + dt.timedelta(days=i * 6)) for i in range(400)]
    made = {
        "lineitem": (line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"),
        "orders": ([(k, k, "12345"[k % 5]) for k in range(40)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "supplier": ([(k, k % 2, 1.0) for k in range(5)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, kind) in made.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_folds_are_read_not_joined(spark, tables):
    made = modelling._folds(spark, tables)
    assert [k for k, _, _ in made] == [1, 2, 3, 4]
    whole = modelling._model_table(spark, tables)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    spec = SP.rolling_folds(*SP.day_range(whole, "FL_DATE"), SP.FoldSpec(24, 12, 12))
    for (k, train, val), fold in zip(made, spec, strict=True):
        for rows, a, b in ((train, fold.train_start, fold.val_start), (val, fold.val_start, fold.val_end)):
            assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
            want = whole.filter((F.col("FL_DATE") >= F.lit(a)) & (F.col("FL_DATE") < F.lit(b)))
            want = SP.downsample(want, "ARR_DEL15", keys) if rows is train else want
            cols = [*keys, *modelling._FEATURES, "ARR_DEL15"]
            got = sorted(map(tuple, rows.select(*cols).collect()))
            assert got and got == sorted(map(tuple, want.select(*cols).collect()))
            assert {r[0] for r in rows.select("fold").distinct().collect()} == {k}

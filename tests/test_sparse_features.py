"""Vectors of many slots: slots are read without laying out zeros, labels reach the JVM in one call."""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skyfold.catalog import training
from skyfold.operators import featurize as X
from skyfold.plans import folds as P


def test_slots_of_sparse_and_dense_vectors(spark):
    nan = float("nan")
    vectors = [Vectors.sparse(5, [1, 3], [2.0, nan]), Vectors.dense([1.0, 0.0, 3.0]), Vectors.sparse(4, [], []), Vectors.dense([])]
    df = spark.createDataFrame([(v, i) for v in vectors for i in (0, 1, 3, 7, -1, None)], ["v", "i"])
    at, whole = F.col("i").cast("int"), vector_to_array("v")
    got = df.select(X.vector_size("v"), X.vector_slot("v", at), F.size(whole), F.get(whole, at)).collect()
    assert len(got) == 24 and all(repr(tuple(r)[:2]) == repr(tuple(r)[2:]) for r in got)


def test_rows_of_vectors_with_many_slots(spark):
    """A row of the feature queries costs what its vector holds: these have 10^9 slots, 8 GB a row when laid out."""
    size = 1_000_000_000
    row = (1, 2, 3, 4, 1, 2.0, 1.0, 7.0, Vectors.sparse(size, [0, 3], [0.5, -0.5]), Vectors.sparse(size, [1, 6, size - 1], [9.0, 1.0, 1.0]))
    names = [*training._KEYS, "ARR_DEL15", "OP_UNIQUE_CARRIER_idx", "ORIGIN_idx", "TAIL_NUM_idx", "log_scaled_features", "full_unscaled_features"]
    got = training._vector_rows(spark.createDataFrame([row], names)).first()
    assert tuple(got)[5:] == (2, 1, 7, 0.5, 0.0, 0.0, -0.5, 0.0, 9.0, 0.0, 0.0, 1.0, 1.0)


def test_index_from_labels(spark):
    df = spark.createDataFrame([("a",), ("",), ("b",), ("x\x1fy",), (None,)], "c string")
    for labels, want in ((["b", "a", ""], [1, 2, 0, 3, 3]), (["x"], [1] * 5), ([""], [1, 0, 1, 1, 1]), (["x\x1fy", "a"], [1, 2, 2, 0, 2])):
        model = X.index_model("c", labels)
        assert [list(x) for x in model.labelsArray] == [labels]
        assert [r[0] for r in model.transform(df).select("c_idx").collect()] == want
    began = time.time()
    assert len(X.index_model("c", [f"T{i}" for i in range(60_000)]).labels) == 60_000
    assert time.time() - began < 10  # one call per label took 17 s


def test_folds_read_their_own_folders(spark):
    """The stored fold table has a folder per fold and role, and no part of a fold reads another's."""
    cfg = X.FeatureConfig(["n"], ["c"], label="y")
    data = [(k, r, float(i), "ab"[i % 2], i % 2) for k in (1, 2) for r in ("train", "val") for i in range(6)]
    table = training.stored(spark.createDataFrame(data, "fold int, role string, n double, c string, y int"), "folds", ["fold", "role"])
    assert dict(table.dtypes)["fold"] == "int" and table.count() == 24
    for k, _, train, val in P.feature_folds(table, [1, 2], cfg):
        for rows, role in ((train, "train"), (val, "val")):
            assert rows.count() == 6 and {r[0] for r in rows.select("fold").collect()} == {k}

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyfold.operators import featurize as X
from skyfold.operators import splits as SP
from skyfold.operators.features import clean_nulls, previous_leg_features, repair_label
from skyfold.operators.quality import leakage_audit, require_no_leakage
from skyfold.operators.reports import histogram, rate_matrix
from tests.conftest import rows

DAY = dt.date


def test_month_steps_and_holdouts():
    assert SP.add_months(DAY(2015, 1, 31), 1) == DAY(2015, 2, 28)
    assert SP.add_months(DAY(2015, 3, 15), -3) == DAY(2014, 12, 15)
    h = SP.holdout_for("all", DAY(2015, 1, 1))
    assert (h.test_start, h.test_end) == (DAY(2019, 1, 1), DAY(2020, 1, 1))
    assert SP.holdout_for(12, DAY(2019, 1, 1)).test_start == DAY(2019, 10, 1)
    assert SP.holdout_for(3, DAY(2015, 1, 1)).test_end == DAY(2015, 4, 1)


@pytest.mark.parametrize(("size", "start", "end", "n"), [(3, DAY(2015, 1, 1), DAY(2015, 2, 28), 1),
    (6, DAY(2015, 1, 1), DAY(2015, 5, 31), 3), (12, DAY(2019, 1, 1), DAY(2019, 9, 30), 6),
    ("all", DAY(2015, 1, 1), DAY(2018, 12, 31), 2), ("all", DAY(2015, 1, 1), DAY(2018, 12, 30), 1)])
def test_number_of_folds(size, start, end, n):
    folds = SP.rolling_folds(start, end, SP.fold_spec_for(size))
    assert len(folds) == n
    assert all(f.train_start < f.val_start < f.val_end for f in folds)
    assert [f.number for f in folds] == list(range(1, n + 1))


def test_boundaries_are_half_open(spark):
    days = [DAY(2014, 12, 31), DAY(2015, 1, 1), DAY(2018, 12, 31), DAY(2019, 1, 1), DAY(2019, 12, 31), DAY(2020, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("t", F.col("d").cast("timestamp_ntz"))
    got = rows(SP.apply_holdout(df, "t", SP.holdout_for("all", DAY(2015, 1, 1))).select("d", "split"))
    assert [(d.isoformat(), s) for d, s in got] == [
        ("2015-01-01", "train"), ("2018-12-31", "train"), ("2019-01-01", "test"), ("2019-12-31", "test")]


def test_folds_of_a_row(spark):
    df = spark.createDataFrame([(DAY(2015, m, 1),) for m in range(1, 7)] + [(None,)], "d date")
    folds = SP.rolling_folds(DAY(2015, 1, 1), DAY(2015, 5, 31), SP.fold_spec_for(6))
    got = rows(SP.assign_folds(df, "d", folds))
    of = {}
    for d, k, r in got:
        of.setdefault(d.month, []).append((k, r))
    assert of == {1: [(1, "train")], 2: [(1, "train"), (2, "train")], 3: [(1, "val"), (2, "train"), (3, "train")],
                  4: [(2, "val"), (3, "train")], 5: [(3, "val")]}
    assert SP.assign_folds(df, "d", []).count() == 0


@pytest.mark.parametrize(("pos", "neg"), [(100, 900), (500, 500), (900, 100), (0, 50), (50, 0)])
def test_downsample(spark, pos, neg):
    df = spark.range(pos + neg).withColumn("y", (F.col("id") < pos).cast("int"))
    got = {r["y"]: r["count"] for r in SP.downsample(df, "y", "id").groupBy("y").count().collect()}
    assert got.get(1, 0) == pos
    if 0 < pos < neg:
        assert abs(got[0] - pos) < 5 * pos**0.5
    elif pos >= neg:
        assert got.get(0, 0) == neg
    again = SP.downsample(df.repartition(3), "y", "id")
    assert rows(again) == rows(SP.downsample(df, "y", "id"))


def test_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(0,)] * 90, "y int")
    got = rows(SP.add_class_weights(df, "y").groupBy("y").agg(F.sum("weight")))
    assert [round(r[1], 6) for r in got] == [50.0, 50.0]
    some = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "y string")
    assert [r[1] for r in rows(SP.add_class_weights(some, "y"))] == [2 / 3, 2 / 3, 4 / 3, 4 / 3]


def _t(minutes):
    return dt.datetime(2019, 1, 1) + dt.timedelta(minutes=minutes)


def test_previous_leg_cut_off(spark):
    gap = dt.timedelta(seconds=3661)
    dep = _t(600)

    def pair(k, arr, late):
        return [(k, f"{k}1", _t(0), _t(90), arr, late), (k, f"{k}2", dep, _t(700), _t(700), 0.0)]

    data = pair("at", dep - gap, 5.0) + pair("before", dep - gap - dt.timedelta(seconds=1), 5.0)
    data += pair("after", dep - gap + dt.timedelta(seconds=1), 5.0) + pair("early", _t(80), -3.0) + pair("none", None, None)
    data += [(None, "n1", _t(0), _t(90), _t(90), 1.0), (None, "n2", dep, _t(700), _t(700), 1.0)]
    df = spark.createDataFrame(data, "tail string, id string, dep timestamp_ntz, sarr timestamp_ntz, arr timestamp_ntz, late double")
    out = previous_leg_features(df, key="tail", sched_dep="dep", sched_arr="sarr", arr="arr", arr_delay="late", tie="id")
    got = {r["id"]: r for r in out.collect()}
    delay = {k: got[f"{k}2"]["prev_flight_arr_delay_clean"] for k in ("at", "before", "after", "early", "none")}
    assert delay == {"at": None, "before": 5.0, "after": None, "early": None, "none": None}
    turn = {k: got[f"{k}2"]["actual_to_crs_time_to_next_flight_diff_mins_clean"] for k in ("before", "after", "early")}
    assert round(turn["before"], 4) == round(3662 / 60, 4) and turn["after"] is None and turn["early"] == 520
    assert got["at2"]["crs_time_to_next_flight_diff_mins"] == 510
    assert got["n2"]["crs_time_to_next_flight_diff_mins"] is None and got["at1"]["leakage"] is None
    audit = leakage_audit(out, "leakage", 3661 / 3600, ["prev_flight_arr_delay_clean"]).first()
    assert audit["prev_flight_arr_delay_clean_violations"] == 0 and audit["risk_rows"] == 1
    assert require_no_leakage(out, "leakage", 3661 / 3600, ["prev_flight_arr_delay_clean"]) is out
    bad = out.withColumn("prev_flight_arr_delay_clean", F.lit(1.0))
    with pytest.raises(ValueError, match="prev_flight_arr_delay_clean"):
        require_no_leakage(bad, "leakage", 3661 / 3600, ["prev_flight_arr_delay_clean"])


def test_cleaning(spark):
    df = spark.createDataFrame([(None, 1.0, None, "x"), (2.0, None, None, None), (4.0, 3.0, None, None)],
                               "z double, m double, a string, s string")
    out, still, report = clean_nulls(df, ["z", "absent"], ["m"], {"a": 29.92}, expected=["z"], accuracy=None)
    assert [(r["z"], r["m"]) for r in out.collect()] == [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)]
    assert still == ["a", "s"]  # a number fills no text column
    got = {r["column_name"]: tuple(r)[1:] for r in report.collect()}
    assert got == {"z": (1, 0, True), "m": (1, 0, False), "a": (3, 3, False), "s": (2, 2, False)}
    lab = spark.createDataFrame([(None, 80.0, 60.0), (None, 70.0, 60.0), (None, None, 60.0), (1, 0.0, 60.0)], "y int, a double, p double")
    assert [r["y"] for r in repair_label(lab, "y", "a", "p").collect()] == [1, 0, 0, 1]


def test_skew_gate(spark):
    data = [(float(i), 5.0, float(-(2**i)), float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(data, "flat double, const double, skewed double, small double")
    fitted = X.SkewLog(["flat", "const", "skewed", "small"]).fit(df)
    assert fitted.chosen == ("skewed",)
    r = fitted.transform(df).filter("flat = 3").first()
    assert abs(r["skewed_log"] + 2.1972245773) < 1e-9 and "flat_log" not in fitted.transform(df).columns


def test_feature_vectors(spark):
    data = [(float(i), float(2 ** (i % 11)), "abc"[i % 3], i % 2, None if i % 5 == 0 else 1, i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "n double, s double, c string, q int, f int, y int")
    cfg = X.FeatureConfig(["n", "s"], ["c", "q"], ["f"], ["n", "s"], label="y")
    model, train, done = X.fit_apply(cfg, df.filter("n < 40"), {"val": df.filter("n >= 40")}, "n")
    slots = dict(X.vector_slots(train, "log_unscaled_features"))
    assert slots[0] == "num_vector_n" and slots[1] == "num_vector_s_log" and slots[max(slots)] == "f"
    assert len(dict(X.vector_slots(train, "full_unscaled_features"))) == len(slots)
    assert X.slot_names(list(slots.items()), [0, 99]) == {0: "num_vector_n"}
    assert done["val"].count() == 20 and done["val"].filter("f = 0.0").count() == 4
    assert X.cardinalities(model, {"q": 4}) == {"c": 4, "q": 4}
    unseen = df.limit(1).withColumn("c", F.lit("new"))
    assert X.flags_to_double(unseen, ["f"]).count() == model.transform(X.flags_to_double(unseen, ["f"])).count() == 1


def test_histogram_and_matrix(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.5, 1, 9.99, 10]] + [(None,)], "v double")
    assert [r[:2] for r in rows(histogram(df, "v", 10), "bin")] == [(0, 2), (1, 1), (9, 2)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r[:2] for r in rows(histogram(same, "v", 5), "bin")] == [(0, 2)]
    m = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 2, 1), ("b", 9, 1)], "r string, c int, y int")
    assert rows(rate_matrix(m, "r", "c", [1, 2, 3], "y", -1.0)) == [("a", 50.0, -1.0, -1.0), ("b", -1.0, 100.0, -1.0)]

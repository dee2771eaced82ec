from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyfold.functions import clock as C
from skyfold.functions import labels as L
from skyfold.functions.codes import parse_present_weather, parse_sky
from skyfold.plans.enrich import holiday_dates
from tests.conftest import rows

HOUR = dt.timedelta(hours=1)


def test_holidays_follow_their_rules():
    days = dict((d.isoformat(), n) for d, n in C.us_holidays([2015, 2019]))
    assert len(days) == 22
    assert days["2015-01-19"] == "Martin Luther King Jr. Day"
    assert days["2015-05-25"] == days["2019-05-27"] == "Memorial Day"
    assert days["2015-11-26"] == days["2019-11-28"] == "Thanksgiving Day"
    assert days["2019-10-14"] == "Columbus Day" and days["2019-02-18"] == "Presidents Day"
    assert len(holiday_dates()) == 56 and holiday_dates()[-1] == dt.date(2020, 1, 1)


def test_near_date_flags_without_fan_out(spark):
    days = [dt.date(2015, 12, d) for d in range(20, 32)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date")
    got = rows(df.select("d", C.near_date("d", holiday_dates()).alias("f")), "d")
    assert len(got) == len(days) + 1  # 24 and 25 December are both holidays: still one row each
    flags = {d.day: f for d, f in got if d}
    assert [flags[k] for k in range(20, 32)] == [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1, 1]
    assert got[0] == (None, 0)


def _clock_frame(spark, rows_):
    names = "id int, FL_DATE date, CRS_DEP_TIME int, DEP_TIME int, DEP_DELAY double, CRS_ARR_TIME int, ARR_TIME int"
    df = spark.createDataFrame(rows_, names)
    return df.withColumns({"ORIGIN_TIMEZONE": F.lit("UTC"), "DEST_TIMEZONE": F.lit("UTC")})


D = dt.date(2019, 3, 5)


def at(day, hour, minute=0):
    return dt.datetime(2019, 3, day, hour, minute)


@pytest.mark.parametrize(
    ("row", "corrected", "dep", "arr", "crs_dep", "crs_arr"),
    [
        # plain day
        ((900, 905, 5.0, 1100, 1110), False, at(5, 9, 5), at(5, 11, 10), at(5, 9), at(5, 11)),
        # late past midnight: departs next day; the arrival does not roll over and keeps the flight date
        ((2350, 20, 30.0, 130, 200), False, at(6, 0, 20), at(5, 2), at(5, 23, 50), at(6, 1, 30)),
        ((2350, 20, 30.0, 130, 200), True, at(6, 0, 20), at(6, 2), at(5, 23, 50), at(6, 1, 30)),
        # early departure stays on its day although its clock is before the scheduled one
        ((10, 5, -5.0, 200, 155), False, at(5, 0, 5), at(5, 1, 55), at(5, 0, 10), at(5, 2)),
        # overnight arrival
        ((2200, 2200, 0.0, 130, 120), False, at(5, 22), at(6, 1, 20), at(5, 22), at(6, 1, 30)),
        # each clock at 2400; departing at 2400 dates the arrival two days on when it rolls over
        ((2400, 2400, 0.0, 2400, 2400), False, at(6, 0), at(7, 0), at(5, 0), at(6, 0)),
        ((2400, 2400, 0.0, 2400, 2400), True, at(6, 0), at(7, 0), at(6, 0), at(6, 0)),
        # never departed
        ((900, None, None, 1100, None), False, None, None, at(5, 9), at(5, 11)),
    ],
)
def test_clock_rules(spark, row, corrected, dep, arr, crs_dep, crs_arr):
    out = C.local_clock_to_utc(_clock_frame(spark, [(1, D, *row)]), corrected=corrected).first()
    assert out["DEP_DATETIME_UTC"] == dep
    assert out["ARR_DATETIME_UTC"] == arr
    assert out["CRS_DEP_DATETIME_UTC"] == crs_dep
    assert out["CRS_ARR_DATETIME_UTC"] == crs_arr
    assert out["CRS_DEP_HOUR"] == row[0] // 100
    assert out["DEP_HOUR"] == (row[1] // 100 if row[1] is not None else None)


def test_zones_with_daylight_saving(spark):
    df = spark.createDataFrame(
        [("America/New_York", dt.datetime(2019, 3, 10, 1, 30)), ("America/New_York", dt.datetime(2019, 3, 10, 3, 30)),
         ("America/Chicago", dt.datetime(2019, 7, 1, 12)), (None, dt.datetime(2019, 7, 1, 12))],
        "z string, t timestamp_ntz",
    )
    got = [r[0] for r in df.select(C.to_utc("t", "z")).collect()]
    assert got == [dt.datetime(2019, 3, 10, 6, 30), dt.datetime(2019, 3, 10, 7, 30), dt.datetime(2019, 7, 1, 17), None]


def test_invalid_clock_is_null(spark):
    df = spark.createDataFrame([(D, 975), (D, 2359), (None, 100)], "d date, c int")
    assert [r[0] for r in df.select(C.clock_on("d", "c")).collect()] == [None, at(5, 23, 59), None]


def test_epoch_seconds_ignores_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 2, 0, 0, 0, 999999),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        assert df.select(C.epoch_seconds("t")).first()[0] == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hour_block(spark):
    df = spark.createDataFrame([(134,), (5,), (2359,), (2400,), (None,)], "c int")
    got = [r[0] for r in df.select(C.hour_block("c")).collect()]
    assert got[:4] == ["0100-0159", "0000-0059", "2300-2359", "2400-2459"]


WX = {
    "": set(),
    None: set(),
    "*": set(),
    "NULL": set(),
    "-RA:02": {"light", "rain_or_drizzle"},
    "+TSRA": {"heavy", "thunderstorm"},
    "TSRA:05": {"thunderstorm"},
    "VCTS": {"thunderstorm", "spatial_effects"},
    "BLSN": {"snow", "spatial_effects"},
    "FZRA": {"freezing_conditions"},
    "-FZDZ:3": {"light", "freezing_conditions"},
    "UP:09": {"unknown_precip"},
    "SQ:3": {"thunderstorm"},
    "-ra:02 br:1 |RA": {"light", "rain_or_drizzle", "reduced_visibility"},
    "RA*SN": set(),
    "MI FG:2": {"spatial_effects", "reduced_visibility"},
    "GRX": set(),
    "PL|IC:1": {"hail_or_ice"},
    "SHSN:1": {"snow"},
}


def test_present_weather(spark):
    df = spark.createDataFrame([(k,) for k in WX], "HourlyPresentWeatherType string")
    for r in parse_present_weather(df).collect():
        flags = {f for f, v in r.asDict().items() if v == 1}
        assert flags == WX[r["HourlyPresentWeatherType"]], r
    label = {r[0]: r["ReadableWeather"] for r in parse_present_weather(df).collect()}
    assert label["-RA:02"] == "light_weather rain_or_drizzle" and label[""] == ""


def test_sky_layers(spark):
    codes = [None, "CLR:00", "FEW:02 25", "FEW:02 25 BKN:07 100", "SCT:04 OVC:08 9 30 120", "BKN:07 OVC:08 20", "7 FEW:2"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, HourlySkyConditions string")
    got = {r["i"]: r for r in parse_sky(df, extended=True).collect()}
    for i in (0, 1, 6):
        assert got[i]["layers"] == [] and got[i]["overall_cloud_frac_0_1"] == 0 and got[i]["sky_missing"] == 1
        assert got[i]["lowest_cloud_ft"] is None and got[i]["ceiling_ft"] == 0
    assert (got[2]["has_few"], got[2]["overall_cloud_frac_0_1"], got[2]["lowest_cloud_ft"]) == (1, 0.25, 2500)
    assert (got[3]["overall_cloud_frac_0_1"], got[3]["highest_cloud_ft"], got[3]["ceiling_ft"]) == (0.875, 10000, 10000)
    assert got[3]["mean_base_ft"] == 6250 and got[3]["base_range_ft"] == 7500
    # one-digit base is no base; pairs by position, the third layer does not exist
    assert [tuple(x) for x in got[4]["layers"]] == [("SCT", 4, 3000), ("OVC", 8, 12000)]
    # more coverage groups than bases: the rest has no base
    assert [tuple(x) for x in got[5]["layers"]] == [("BKN", 7, 2000), ("OVC", 8, None)]
    assert got[5]["mean_base_ft"] is None and got[5]["ceiling_ft"] == 2000


def test_sectors(spark):
    cases = [(None, "Calm"), ("0", "Calm"), ("360", "Calm"), ("22.4", "N"), ("22.5", "NE"), ("337.4", "NW"),
             ("337.5", "N"), ("VRB", "OTHER"), ("90", "E"), ("180", "S"), ("247.5", "W")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "d string")
    assert [r[0] for r in df.select(L.sector_label("d")).collect()] == [s for _, s in cases]


def test_labels(spark):
    df = spark.createDataFrame([(200000,), (1500,), (999,), (3250,), (1000,)], "n bigint")
    assert [r[0] for r in df.select(L.thousands_label("n")).collect()] == ["200K", "1.5K", "999", "3.2K", "1K"]
    causes = ["CARRIER_DELAY", "LATE_AIRCRAFT_DELAY"]
    df = spark.createDataFrame([(1.0, 2.0), (0.0, None), (None, 5.0)], "CARRIER_DELAY double, LATE_AIRCRAFT_DELAY double")
    assert [r[0] for r in df.select(L.cause_combo(causes)).collect()] == ["Carrier & Late Aircraft", "", "Late Aircraft"]
    assert L.explode_causes(df, causes).count() == 3
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert df.select(L.composite_id("x", "y", "z")).first()[0] == "a_b"
    df = spark.createDataFrame([(-3.0,), (0.0,), (3.0,)], "x double")
    a, b, c = [r[0] for r in df.select(L.signed_log("x")).collect()]
    assert a == -c and b == 0 and abs(c - 1.3862943611) < 1e-9


def test_bins_and_category_order(spark):
    df = spark.createDataFrame([(None,), (4,), (5,), (24,), (25,)], "w int")
    bins = ([(5, "a"), (25, "b")], "c")
    assert [r[0] for r in df.select(L.bin_label("w", *bins)).collect()] == ["c", "a", "b", "b", "c"]
    assert [r[0] for r in df.select(L.bin_label("w", *bins, null_label="n")).collect()] == ["n", "a", "b", "b", "c"]
    names = spark.createDataFrame([("x",), ("low",), ("high",)], "c string")
    assert [r[0] for r in L.order_by_category(names, "c", ["high", "low"]).collect()] == ["high", "low", "x"]

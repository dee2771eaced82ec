"""Fixed values of the flight domain. Operators take them as parameters and hold none themselves."""

from __future__ import annotations

# Airports outside the area of study.
EXCLUDED_AIRPORTS = ["BQN", "STT", "GUM", "SJU", "ISN", "PSE", "PPG", "STX"]

# Study period, both ends included.
STUDY_PERIOD = ("2015-01-01", "2020-01-01")

# Flight columns kept for the enriched table.
FLIGHT_COLUMNS = [
    "YEAR",
    "QUARTER",
    "MONTH",
    "DAY_OF_MONTH",
    "DAY_OF_WEEK",
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "TAIL_NUM",
    "OP_CARRIER_FL_NUM",
    "ORIGIN_CITY_MARKET_ID",
    "ORIGIN",
    "ORIGIN_CITY_NAME",
    "ORIGIN_STATE_ABR",
    "ORIGIN_STATE_FIPS",
    "ORIGIN_STATE_NM",
    "ORIGIN_WAC",
    "DEST_CITY_MARKET_ID",
    "DEST",
    "DEST_CITY_NAME",
    "DEST_STATE_ABR",
    "DEST_STATE_FIPS",
    "DEST_STATE_NM",
    "DEST_WAC",
    "CRS_DEP_TIME",
    "DEP_TIME",
    "DEP_DELAY",
    "DEP_DEL15",
    "DEP_TIME_BLK",
    "TAXI_OUT",
    "WHEELS_OFF",
    "WHEELS_ON",
    "TAXI_IN",
    "CRS_ARR_TIME",
    "ARR_TIME",
    "ARR_DELAY",
    "ARR_DEL15",
    "ARR_TIME_BLK",
    "CANCELLED",
    "DIVERTED",
    "CRS_ELAPSED_TIME",
    "ACTUAL_ELAPSED_TIME",
    "AIR_TIME",
    "CARRIER_DELAY",
    "WEATHER_DELAY",
    "NAS_DELAY",
    "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY",
    "DISTANCE",
    "DISTANCE_GROUP",
]

# Parts of the composite flight id, in order.
FLIGHT_ID_PARTS = ["FL_DATE", "CRS_DEP_TIME", "TAIL_NUM", "OP_CARRIER_FL_NUM", "ORIGIN", "DEST"]

# Flags read from the present-weather codes, in order of the label.
WEATHER_FLAGS = [
    "light",
    "heavy",
    "thunderstorm",
    "rain_or_drizzle",
    "freezing_conditions",
    "snow",
    "hail_or_ice",
    "reduced_visibility",
    "spatial_effects",
    "unknown_precip",
]

SKY_FLAGS = ["has_few", "has_sct", "has_bkn", "has_ovc"]

# Weather columns carried into the enriched table.
WEATHER_COLUMNS = (
    [
        "STATION",
        "DATE",
        "LATITUDE",
        "LONGITUDE",
        "ELEVATION",
        "NAME",
        "REPORT_TYPE",
        "SOURCE",
        "overall_cloud_frac_0_1",
        "lowest_cloud_ft",
        "highest_cloud_ft",
    ]
    + SKY_FLAGS
    + ["HourlyAltimeterSetting", "HourlyWindDirection", "HourlyWindGustSpeed", "HourlyWindSpeed"]
    + WEATHER_FLAGS
)

# Delay causes, in order.
CAUSE_COLUMNS = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"]

# Holidays whose date follows from a rule; see ``skyfold.functions.clock.us_holidays``.
HOLIDAY_YEARS = range(2015, 2020)
EXTRA_HOLIDAYS = [("2020-01-01", "New Year's Day")]

# Seconds before the scheduled departure at which a prediction is made (61 min 1 s).
PREDICTION_GAP_SECONDS = 3661

# As-of enrichment, hours.
WEATHER_OFFSET_HOURS = 1
WEATHER_TOLERANCE_HOURS = 8

# What replaces a missing value.
ZERO_FILL = (
    CAUSE_COLUMNS
    + ["overall_cloud_frac_0_1", "lowest_cloud_ft", "highest_cloud_ft"]
    + SKY_FLAGS
    + ["HourlyWindDirection", "HourlyWindSpeed", "HourlyWindGustSpeed"]
    + WEATHER_FLAGS
    + ["origin_pagerank", "dest_pagerank", "origin_out_degree", "dest_in_degree"]
    + ["prev_flight_arr_delay_clean", "actual_to_crs_time_to_next_flight_diff_mins_clean"]
)
MEDIAN_FILL = ["crs_time_to_next_flight_diff_mins"]
CONSTANT_FILL = {"HourlyAltimeterSetting": 29.92}

# Columns in which nulls are expected before cleaning.
EXPECTED_NULLS = (
    CAUSE_COLUMNS
    + ["overall_cloud_frac_0_1", "lowest_cloud_ft", "highest_cloud_ft"]
    + SKY_FLAGS
    + ["HourlyWindDirection", "HourlyWindSpeed", "HourlyWindGustSpeed", "HourlyAltimeterSetting"]
    + ["WX_STATION", "MATCHED_OBS_TIME_UTC", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME", "REPORT_TYPE", "SOURCE"]
    + WEATHER_FLAGS
)

# Enforced column types.
TYPES = {c: "double" for c in ["ORIGIN_LAT", "ORIGIN_LONG", "HourlyAltimeterSetting", "DEST_LAT", "DEST_LON"]} | {
    c: "int"
    for c in [
        "ARR_DEL15",
        "CARRIER_DELAY",
        "NAS_DELAY",
        "SECURITY_DELAY",
        "LATE_AIRCRAFT_DELAY",
        "HourlyWindGustSpeed",
        "HourlyWindSpeed",
        "HourlyWindDirection",
    ]
}

# Columns of the model table.
MODEL_COLUMNS = [
    "YEAR",
    "QUARTER",
    "MONTH",
    "DAY_OF_MONTH",
    "DAY_OF_WEEK",
    "IS_US_HOLIDAY",
    "OP_UNIQUE_CARRIER",
    "TAIL_NUM",
    "ORIGIN",
    "ORIGIN_STATE_ABR",
    "DEST",
    "DEST_STATE_ABR",
    "CRS_DEP_TIME_BLOCK",
    "CRS_DEP_DATETIME_UTC",
    "CRS_ARR_TIME_BLOCK",
    "ARR_DEL15",
    "CRS_ELAPSED_TIME",
    "CARRIER_DELAY",
    "NAS_DELAY",
    "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY",
    "DISTANCE",
    "ORIGIN_LAT",
    "ORIGIN_LONG",
    "ORIGIN_ELEVATION_FT",
    "ORIGIN_SIZE",
    "DEST_LAT",
    "DEST_LON",
    "DEST_ELEVATION_FT",
    "DEST_SIZE",
    "overall_cloud_frac_0_1",
    "lowest_cloud_ft",
    "highest_cloud_ft",
    "has_few",
    "has_sct",
    "has_bkn",
    "has_ovc",
    "HourlyAltimeterSetting",
    "HourlyWindCardinalDirection",
    "HourlyWindGustSpeed",
    "HourlyWindSpeed",
    "light",
    "heavy",
    "thunderstorm",
    "rain_or_drizzle",
    "freezing_conditions",
    "snow",
    "hail_or_ice",
    "reduced_visibility",
    "spatial_effects",
    "unknown_precip",
    "origin_pagerank",
    "dest_pagerank",
    "origin_out_degree",
    "dest_in_degree",
    "prev_flight_arr_delay_clean",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
    "crs_time_to_next_flight_diff_mins",
]

# Column groups for modelling.
LABEL = "ARR_DEL15"
NUMERIC = [
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "ORIGIN_LAT",
    "ORIGIN_LONG",
    "ORIGIN_ELEVATION_FT",
    "DEST_LAT",
    "DEST_LON",
    "DEST_ELEVATION_FT",
    "overall_cloud_frac_0_1",
    "lowest_cloud_ft",
    "highest_cloud_ft",
    "HourlyAltimeterSetting",
    "HourlyWindGustSpeed",
    "HourlyWindSpeed",
    "origin_pagerank",
    "dest_pagerank",
    "origin_out_degree",
    "dest_in_degree",
    "prev_flight_arr_delay_clean",
    "crs_time_to_next_flight_diff_mins",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
]
LOG_CANDIDATES = [
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "ORIGIN_ELEVATION_FT",
    "DEST_ELEVATION_FT",
    "lowest_cloud_ft",
    "highest_cloud_ft",
    "HourlyWindGustSpeed",
    "HourlyWindSpeed",
    "origin_out_degree",
    "dest_in_degree",
    "crs_time_to_next_flight_diff_mins",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
]
FLAGS = [
    "light",
    "heavy",
    "thunderstorm",
    "rain_or_drizzle",
    "freezing_conditions",
    "snow",
    "hail_or_ice",
    "reduced_visibility",
    "spatial_effects",
    "unknown_precip",
]

SKY_FLAGS = ["has_few", "has_sct", "has_bkn", "has_ovc"]

# Weather columns carried into the enriched table.
WEATHER_COLUMNS = (
    [
        "STATION",
        "DATE",
        "LATITUDE",
        "LONGITUDE",
        "ELEVATION",
        "NAME",
        "REPORT_TYPE",
        "SOURCE",
        "overall_cloud_frac_0_1",
        "lowest_cloud_ft",
        "highest_cloud_ft",
    ]
    + SKY_FLAGS
    + ["HourlyAltimeterSetting", "HourlyWindDirection", "HourlyWindGustSpeed", "HourlyWindSpeed"]
    + WEATHER_FLAGS
)

# Delay causes, in order.
CAUSE_COLUMNS = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"]

# Holidays whose date follows from a rule; see ``skyfold.functions.clock.us_holidays``.
HOLIDAY_YEARS = range(2015, 2020)
EXTRA_HOLIDAYS = [("2020-01-01", "New Year's Day")]

# Seconds before the scheduled departure at which a prediction is made (61 min 1 s).
PREDICTION_GAP_SECONDS = 3661

# As-of enrichment, hours.
WEATHER_OFFSET_HOURS = 1
WEATHER_TOLERANCE_HOURS = 8

# What replaces a missing value.
ZERO_FILL = (
    CAUSE_COLUMNS
    + ["overall_cloud_frac_0_1", "lowest_cloud_ft", "highest_cloud_ft"]
    + SKY_FLAGS
    + ["HourlyWindDirection", "HourlyWindSpeed", "HourlyWindGustSpeed"]
    + WEATHER_FLAGS
    + ["origin_pagerank", "dest_pagerank", "origin_out_degree", "dest_in_degree"]
    + ["prev_flight_arr_delay_clean", "actual_to_crs_time_to_next_flight_diff_mins_clean"]
)
MEDIAN_FILL = ["crs_time_to_next_flight_diff_mins"]
CONSTANT_FILL = {"HourlyAltimeterSetting": 29.92}

# Columns in which nulls are expected before cleaning.
EXPECTED_NULLS = (
    CAUSE_COLUMNS
    + ["overall_cloud_frac_0_1", "lowest_cloud_ft", "highest_cloud_ft"]
    + SKY_FLAGS
    + ["HourlyWindDirection", "HourlyWindSpeed", "HourlyWindGustSpeed", "HourlyAltimeterSetting"]
    + ["WX_STATION", "MATCHED_OBS_TIME_UTC", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME", "REPORT_TYPE", "SOURCE"]
    + WEATHER_FLAGS
)

# Enforced column types.
TYPES = {c: "double" for c in ["ORIGIN_LAT", "ORIGIN_LONG", "HourlyAltimeterSetting", "DEST_LAT", "DEST_LON"]} | {
    c: "int"
    for c in [
        "ARR_DEL15",
        "CARRIER_DELAY",
        "NAS_DELAY",
        "SECURITY_DELAY",
        "LATE_AIRCRAFT_DELAY",
        "HourlyWindGustSpeed",
        "HourlyWindSpeed",
        "HourlyWindDirection",
    ]
}

# Columns of the model table.
MODEL_COLUMNS = [
    "YEAR",
    "QUARTER",
    "MONTH",
    "DAY_OF_MONTH",
    "DAY_OF_WEEK",
    "IS_US_HOLIDAY",
    "OP_UNIQUE_CARRIER",
    "TAIL_NUM",
    "ORIGIN",
    "ORIGIN_STATE_ABR",
    "DEST",
    "DEST_STATE_ABR",
    "CRS_DEP_TIME_BLOCK",
    "CRS_DEP_DATETIME_UTC",
    "CRS_ARR_TIME_BLOCK",
    "ARR_DEL15",
    "CRS_ELAPSED_TIME",
    "CARRIER_DELAY",
    "NAS_DELAY",
    "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY",
    "DISTANCE",
    "ORIGIN_LAT",
    "ORIGIN_LONG",
    "ORIGIN_ELEVATION_FT",
    "ORIGIN_SIZE",
    "DEST_LAT",
    "DEST_LON",
    "DEST_ELEVATION_FT",
    "DEST_SIZE",
    "overall_cloud_frac_0_1",
    "lowest_cloud_ft",
    "highest_cloud_ft",
    "has_few",
    "has_sct",
    "has_bkn",
    "has_ovc",
    "HourlyAltimeterSetting",
    "HourlyWindCardinalDirection",
    "HourlyWindGustSpeed",
    "HourlyWindSpeed",
    "light",
    "heavy",
    "thunderstorm",
    "rain_or_drizzle",
    "freezing_conditions",
    "snow",
    "hail_or_ice",
    "reduced_visibility",
    "spatial_effects",
    "unknown_precip",
    "origin_pagerank",
    "dest_pagerank",
    "origin_out_degree",
    "dest_in_degree",
    "prev_flight_arr_delay_clean",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
    "crs_time_to_next_flight_diff_mins",
]

# Column groups for modelling.
LABEL = "ARR_DEL15"
NUMERIC = [
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "ORIGIN_LAT",
    "ORIGIN_LONG",
    "ORIGIN_ELEVATION_FT",
    "DEST_LAT",
    "DEST_LON",
    "DEST_ELEVATION_FT",
    "overall_cloud_frac_0_1",
    "lowest_cloud_ft",
    "highest_cloud_ft",
    "HourlyAltimeterSetting",
    "HourlyWindGustSpeed",
    "HourlyWindSpeed",
    "origin_pagerank",
    "dest_pagerank",
    "origin_out_degree",
    "dest_in_degree",
    "prev_flight_arr_delay_clean",
    "crs_time_to_next_flight_diff_mins",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
]
LOG_CANDIDATES = (
    "CRS_ELAPSED_TIME DISTANCE ORIGIN_ELEVATION_FT DEST_ELEVATION_FT lowest_cloud_ft highest_cloud_ft "
    "HourlyWindGustSpeed HourlyWindSpeed origin_out_degree dest_in_degree crs_time_to_next_flight_diff_mins "
    "actual_to_crs_time_to_next_flight_diff_mins_clean"
).split()
FLAGS = ["IS_US_HOLIDAY"] + SKY_FLAGS + WEATHER_FLAGS
CATEGORICAL = [
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
    "ORIGIN_STATE_ABR",
    "DEST",
    "DEST_STATE_ABR",
    "ORIGIN_SIZE",
    "DEST_SIZE",
    "HourlyWindCardinalDirection",
]
CYCLICAL = [
    "QUARTER",
    "MONTH",
    "DAY_OF_MONTH",
    "DAY_OF_WEEK",
    "CRS_DEP_TIME_BLOCK",
    "CRS_ARR_TIME_BLOCK",
]

# Reduced feature sets, first for tuning, then for the final fit.
TUNING_NUMERIC = [c for c in NUMERIC if c != "highest_cloud_ft"]
TUNING_FLAGS = [
    "has_few",
    "has_sct",
    "has_bkn",
    "light",
    "heavy",
    "thunderstorm",
    "freezing_conditions",
    "snow",
]
TUNING_CATEGORICAL = [
    "OP_UNIQUE_CARRIER",
    "ORIGIN_STATE_ABR",
    "DEST",
    "DAY_OF_MONTH",
    "DAY_OF_WEEK",
    "CRS_DEP_TIME_BLOCK",
    "CRS_ARR_TIME_BLOCK",
]
FINAL_NUMERIC = [
    "CRS_ELAPSED_TIME",
    "DEST_LON",
    "DEST_ELEVATION_FT",
    "overall_cloud_frac_0_1",
    "lowest_cloud_ft",
    "HourlyAltimeterSetting",
    "dest_in_degree",
    "crs_time_to_next_flight_diff_mins",
    "actual_to_crs_time_to_next_flight_diff_mins_clean",
]
FINAL_CATEGORICAL = [
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
    "DEST",
]

# Continental bounding box (lat from, lat to, lon from, lon to).
CONTINENTAL_BOX = (24.0, 50.0, -125.0, -65.0)

# Names of weekdays and months.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Bins as (upper bound, label) with a last label.
WIND_BINS = ([(5, "0–5 mph"), (15, "5–15 mph"), (25, "15–25 mph")], "25+ mph")
CEILING_BINS = ([(500, "<500 ft (Very low)"), (1000, "500–1000 ft"), (2000, "1000–2000 ft")], ">2000 ft")

# Hold-out (train months, test months) and rolling folds (train, validation, step months) by size.
HOLDOUT_MONTHS = {3: (2, 1), 6: (5, 1), 12: (9, 3), "all": (48, 12)}
FOLD_MONTHS = {3: (1, 1, 1), 6: (2, 1, 1), 12: (3, 1, 1), "all": (24, 12, 12)}
HOLDOUT_START = {3: "2015-01-01", 6: "2015-01-01", 12: "2019-01-01", "all": "2015-01-01"}

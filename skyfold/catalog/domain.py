"""Queries for code parsing, clocks, holidays, bins, graphs, splits and sampling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.catalog.base import legs, query, rounded, table
from skyfold.functions import clock as C
from skyfold.config import WEATHER_FLAGS
from skyfold.functions.codes import first_known, parse_present_weather, parse_sky
from skyfold.functions.labels import sector_label, signed_log
from skyfold.operators import graph as G
from skyfold.operators import splits as SP
from skyfold.plans import eda

# ---------------------------------------------------------------- coded text

# Codes to build test texts from: plain, signed, placeholder, piped and unknown ones.
_WX = ["-RA:02", "+TSRA", "VCTS", "BLSN:05", "FZRA", "UP:09", "SQ:3", "BR:1", "HZ", "GS:1", "MI FG:2", "", "*", "NULL",
       "DZ:01 BR:1 |RA", "SN:03", "VCFG", "PR", "SHRA:1", "ic", "-sg"]
_SKY = ["CLR:00", "FEW:02 25", "SCT:04 50", "BKN:07 100", "OVC:08 7", "FEW:02", "120", "X", "ovc:08 15 30", "*"]


def _pick(codes: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in codes]), index.cast("int"))


def _coded(spark: SparkSession, sf: str, codes: list[str]) -> DataFrame:
    """One coded text per event, of two picks and a pipe; every 29th is null."""
    n = len(codes)
    first, second = F.col("event_id") % n, F.floor(F.col("value") * 10) % n
    text = F.concat_ws("|", _pick(codes, first), _pick(codes, second))
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 29 > 0, text).alias("code"))


def _coded_sql(codes: list[str]) -> str:
    listed = "[" + ", ".join(f"'{c}'" for c in codes) + "]"
    n = len(codes)
    return f"""c AS (SELECT event_id, CASE WHEN event_id % 29 > 0 THEN {listed}[event_id % {n} + 1] || '|' ||
      {listed}[CAST(floor(value * 10) AS BIGINT) % {n} + 1] END AS code FROM events),
    t AS (SELECT *, translate(regexp_replace(upper(coalesce(code, '')), '\\bNULL\\b|\\*', '', 'g'), '|', ' ') AS text FROM c)"""


def _wx_sql(source: str, key: str) -> str:
    """Flags of ``code`` token by token, with conditions of its own; ``source`` is a query with ``key`` and ``code``."""
    return f"""WITH c AS ({source}),
    k AS (SELECT {key}, unnest(string_split_regex(regexp_replace(replace(replace(upper(coalesce(code, '')), '|', ' '), '*', ''), '\\bNULL\\b', '', 'g'),
      '[^A-Z0-9:+\\-]+')) AS tok FROM c),
    w AS (SELECT {key}, tok, string_split_regex(tok, '[:+\\-]') AS ws, tok[3:3] BETWEEN 'A' AND 'Z' OR length(tok) = 2 AS goes_on,
      tok[5:5] BETWEEN 'A' AND 'Z' OR length(tok) = 4 AS goes_on4, regexp_matches(tok, '^..(:[0-9]+)?$') AS numbered FROM k),
    g AS (SELECT {key}, max(tok[1] = '-') AS light, max(tok[1] = '+') AS heavy,
      max(list_contains(ws, 'TSRA') OR list_contains(ws, 'SQ') OR (tok[1:2] = 'TS' AND goes_on) OR (tok[1:4] = 'VCTS' AND goes_on4)) AS thunderstorm,
      max(list_contains(ws, 'RA') OR list_contains(ws, 'DZ') OR list_contains(ws, 'SHRA')) AS rain_or_drizzle,
      max(list_contains(ws, 'FZRA') OR list_contains(ws, 'FZDZ') OR (tok[1:2] = 'FZ' AND goes_on)) AS freezing_conditions,
      max(list_has_any(ws, ['SN', 'SG', 'BLSN', 'DRSN', 'SHSN'])) AS snow,
      max(list_has_any(ws, ['GS', 'GR', 'PL', 'IC', 'HAIL'])) AS hail_or_ice,
      max(list_has_any(ws, ['BR', 'FG', 'FU', 'HZ', 'DU', 'SA', 'VCFG']) OR tok = 'PR') AS reduced_visibility,
      max((tok[1:2] IN ('VC', 'DR', 'BL') AND goes_on) OR (tok[1:2] IN ('MI', 'BC') AND numbered)) AS spatial_effects,
      max(list_contains(ws, 'UP')) AS unknown_precip FROM w GROUP BY {key}),
    f AS (SELECT {key}, code, {', '.join(f'CAST(coalesce(g.{f}, false) AS INTEGER) AS {f}' for f in WEATHER_FLAGS)}
      FROM c LEFT JOIN g USING ({key}))
    SELECT *, concat_ws(' ', {', '.join(
        f"CASE WHEN {f} = 1 THEN '{f + '_weather' if f in ('light', 'heavy') else f}' END" for f in WEATHER_FLAGS)})
      AS "ReadableWeather" FROM f"""


def _codes_of(codes: list[str]) -> str:
    return f"WITH {_coded_sql(codes)} SELECT event_id, code FROM c"


@query(_wx_sql(_codes_of(_WX), "event_id"))
def token_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Present-weather flags of coded texts derived from the events."""
    return parse_present_weather(_coded(spark, sf, _WX), "code")


@query(_wx_sql("SELECT doc_id, text AS code FROM documents", "doc_id").replace("SELECT *, concat_ws", "SELECT * EXCLUDE (code), concat_ws"))
def token_flags_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same token rules over whole document texts."""
    return parse_present_weather(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    f"""WITH {_coded_sql(_SKY)}, w AS (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS toks FROM t),
    u AS (SELECT event_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM w),
    cv AS (SELECT event_id, regexp_extract(tok, '^(FEW|SCT|BKN|OVC)', 1) AS cd,
      CAST(regexp_extract(tok, ':(\\d{{2}})', 1) AS INTEGER) AS okta,
      row_number() OVER (PARTITION BY event_id ORDER BY i) AS r
      FROM u WHERE regexp_matches(tok, '^(FEW|SCT|BKN|OVC):\\d{{2}}$')),
    bs AS (SELECT event_id, CAST(tok AS INTEGER) * 100 AS base, row_number() OVER (PARTITION BY event_id ORDER BY i) AS r
      FROM u WHERE regexp_matches(tok, '^\\d{{2,3}}$')),
    ly AS (SELECT coalesce(cv.event_id, bs.event_id) AS event_id, cd, okta, base FROM cv FULL JOIN bs
      ON cv.event_id = bs.event_id AND cv.r = bs.r),
    ag AS (SELECT event_id, count(*) AS n, max(okta) AS okta, min(base) AS lo, max(base) AS hi, count(base) AS nb,
      sum(base) AS sb, min(base) FILTER (cd IN ('BKN', 'OVC')) AS ceil,
      count(*) FILTER (cd = 'FEW') AS f, count(*) FILTER (cd = 'SCT') AS s, count(*) FILTER (cd = 'BKN') AS b,
      count(*) FILTER (cd = 'OVC') AS o FROM ly GROUP BY 1)
    SELECT c.event_id, code, CAST(coalesce(f, 0) > 0 AS INTEGER) AS has_few, CAST(coalesce(s, 0) > 0 AS INTEGER) AS has_sct,
      CAST(coalesce(b, 0) > 0 AS INTEGER) AS has_bkn, CAST(coalesce(o, 0) > 0 AS INTEGER) AS has_ovc,
      CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE okta / 8.0::DOUBLE END AS overall_cloud_frac_0_1, lo AS lowest_cloud_ft,
      hi AS highest_cloud_ft, coalesce(ceil, 0) AS ceiling_ft,
      round(CASE WHEN nb = n THEN sb / CAST(n AS DOUBLE) END, 6) AS mean_base_ft, hi - lo AS base_range_ft,
      CAST(n IS NULL AS INTEGER) AS sky_missing
    FROM c LEFT JOIN ag ON c.event_id = ag.event_id"""
)
def layer_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Cloud layers of coded texts derived from the events."""
    return rounded(parse_sky(_coded(spark, sf, _SKY), "code", extended=True).drop("layers"), "mean_base_ft")


@query(
    """SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, CASE WHEN user_id % 2 = 0 THEN value * 2 END,
      CASE WHEN event_type = 'click' THEN 0.0::DOUBLE END) AS reading FROM events"""
)
def first_known_reading(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumns(
        {
            "a": F.when(F.col("value") > 50, F.col("value")),
            "b": F.when(F.col("user_id") % 2 == 0, F.col("value") * 2),
            "c": F.when(F.col("event_type") == "click", F.lit(0.0)),
        }
    )
    return df.select("event_id", first_known("a", "b", "c").alias("reading"))


# ---------------------------------------------------------------- clocks, dates, bins

# Zones without daylight saving, so that both engines agree on every local time.
_ZONES = ["America/Phoenix", "Pacific/Honolulu", "America/Puerto_Rico", "Pacific/Guam"]


def _clocked(spark: SparkSession, sf: str) -> DataFrame:
    """Legs with four local clocks (midnight sometimes as 2400, some departures missing) and two zones."""
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    m, late = F.col("_m"), F.col("DEP_DELAY").cast("int")
    stop = F.col("CRS_ELAPSED_TIME").cast("int")

    def hhmm(minute: Column) -> Column:
        x = F.pmod(minute, F.lit(1440))
        return F.when(x == 0, F.lit(2400)).otherwise((F.floor(x / 60) * 100 + x % 60).cast("int"))

    zones = F.array(*[F.lit(z) for z in _ZONES])
    return df.withColumns(
        {
            "CRS_DEP_TIME": hhmm(m),
            "DEP_TIME": F.when(F.col("CANCELLED") == 0, hhmm(m + late)),
            "CRS_ARR_TIME": hhmm(m + stop),
            "ARR_TIME": F.when(F.col("CANCELLED") == 0, hhmm(m + stop + F.col("ARR_DELAY").cast("int"))),
            "ORIGIN_TIMEZONE": F.get(zones, (F.col("l_suppkey") % 4).cast("int")),
            "DEST_TIMEZONE": F.get(zones, (F.col("l_partkey") % 4).cast("int")),
        }
    )


def _hhmm_sql(minute: str) -> str:
    x = f"((({minute}) % 1440 + 1440) % 1440)"
    return f"CAST(CASE WHEN {x} = 0 THEN 2400 ELSE {x} // 60 * 100 + {x} % 60 END AS INTEGER)"


def _at(date: str, clock: str, zone: str) -> str:
    c = f"(CASE WHEN {clock} = 2400 THEN 0 ELSE {clock} END)"
    return f"""((({date})::TIMESTAMP + to_minutes(CAST({c} // 100 * 60 + {c} % 100 AS INTEGER)))
      AT TIME ZONE {zone} AT TIME ZONE 'UTC')"""


def _clock_sql(corrected: bool) -> str:
    stay = "dd" if corrected else "d"
    sched = "CASE WHEN sd = 2400 THEN d + 1 ELSE d END" if corrected else "d"
    zones = "[" + ", ".join(f"'{z}'" for z in _ZONES) + "]"
    dep, arr = 'CAST("DEP_DELAY" AS INTEGER)', 'CAST("ARR_DELAY" AS INTEGER)'
    stop = 'CAST("CRS_ELAPSED_TIME" AS INTEGER)'
    return f"""k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "FL_DATE" AS d, "DEP_DELAY" AS dl,
      {_hhmm_sql('m_')} AS sd, {_hhmm_sql(f'm_ + {stop}')} AS sa,
      CASE WHEN "CANCELLED" = 0 THEN {_hhmm_sql(f'm_ + {dep}')} END AS ad,
      CASE WHEN "CANCELLED" = 0 THEN {_hhmm_sql(f'm_ + {stop} + {arr}')} END AS aa,
      {zones}[l_suppkey % 4 + 1] AS zo, {zones}[l_partkey % 4 + 1] AS zd FROM legs),
    k2 AS (SELECT *, CASE WHEN (ad < sd AND dl > 0) OR ad = 2400 THEN d + 1 ELSE d END AS dd FROM k)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_at('dd', 'ad', 'zo')} AS "DEP_DATETIME_UTC",
      {_at(f'CASE WHEN aa < ad OR aa = 2400 THEN dd + 1 ELSE {stay} END', 'aa', 'zd')} AS "ARR_DATETIME_UTC",
      {_at(sched, 'sd', 'zo')} AS "CRS_DEP_DATETIME_UTC",
      {_at('CASE WHEN sa < sd OR sa = 2400 THEN d + 1 ELSE d END', 'sa', 'zd')} AS "CRS_ARR_DATETIME_UTC",
      CAST(sa // 100 AS INTEGER) AS "CRS_ARR_HOUR", CAST(aa // 100 AS INTEGER) AS "ARR_HOUR",
      CAST(sd // 100 AS INTEGER) AS "CRS_DEP_HOUR", CAST(ad // 100 AS INTEGER) AS "DEP_HOUR" FROM k2"""


_CLOCK_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + [
    f"{n}_{k}" for n in ("DEP", "ARR", "CRS_DEP", "CRS_ARR") for k in ("DATETIME_UTC", "HOUR")
]


@query(f"WITH {_clock_sql(False)}", legs=True)
def local_clock_utc(spark: SparkSession, sf: str) -> DataFrame:
    return C.local_clock_to_utc(_clocked(spark, sf)).select(*_CLOCK_COLS)


@query(f"WITH {_clock_sql(True)}", legs=True)
def local_clock_utc_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return C.local_clock_to_utc(_clocked(spark, sf), corrected=True).select(*_CLOCK_COLS)


_HOLIDAYS = C.us_holidays(range(1995, 2003))


def _holidays_sql(first: int, end: int) -> str:
    """Holidays of the years from ``first`` up to ``end``, by rules of their own: fixed days, n-th weekdays, the last Monday of May."""
    years = f"range({first}, {end}) t(y)"
    return f"""SELECT make_date(y, m, d) AS d FROM {years}, (VALUES (1, 1), (7, 4), (11, 11), (12, 24), (12, 25)) f(m, d)
    UNION ALL SELECT make_date(y, m, 1) + CAST((w - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER)
      FROM {years}, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) f(m, w, n)
    UNION ALL SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM {years}"""


_HOLIDAYS_SQL = _holidays_sql(2015, 2020) + " UNION ALL SELECT DATE '2020-01-01'"


@query(
    "WITH h(d) AS (" + _holidays_sql(1995, 2003) + """)
    SELECT o_orderkey, CAST(EXISTS (SELECT 1 FROM h WHERE abs(date_diff('day', d, CAST(o_orderdate AS DATE))) <= 2)
      AS INTEGER) AS is_holiday FROM orders"""
)
def near_holiday(spark: SparkSession, sf: str) -> DataFrame:
    flag = C.near_date("o_orderdate", [d for d, _ in _HOLIDAYS]).alias("is_holiday")
    return table(spark, sf, "orders").select("o_orderkey", flag)


_DEGREES = "round((value * 7.5) % 361, 1)"


@query(
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'VRB'
      WHEN event_id % 23 = 0 THEN '360' ELSE CAST({_DEGREES} AS VARCHAR) END AS raw FROM events),
    d AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS g FROM e)
    SELECT event_id, CASE WHEN raw IS NULL OR g = 0 OR g = 360 THEN 'Calm' WHEN g >= 337.5 OR g < 22.5 THEN 'N'
      WHEN g < 67.5 THEN 'NE' WHEN g < 112.5 THEN 'E' WHEN g < 157.5 THEN 'SE' WHEN g < 202.5 THEN 'S'
      WHEN g < 247.5 THEN 'SW' WHEN g < 292.5 THEN 'W' WHEN g < 337.5 THEN 'NW' ELSE 'OTHER' END AS sector FROM d"""
)
def sector_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Compass sectors of directions derived from event values, some missing or unreadable."""
    degrees = F.expr(_DEGREES).cast("string")
    i = F.col("event_id")
    raw = F.when(i % 17 == 0, None).when(i % 19 == 0, "VRB").when(i % 23 == 0, "360").otherwise(degrees)
    return table(spark, sf, "events").select("event_id", sector_label(raw).alias("sector"))


@query(
    """SELECT l_orderkey, l_partkey, printf('%02d00-%02d59', "CRS_DEP_TIME" // 100, "CRS_DEP_TIME" // 100)
      AS "CRS_DEP_TIME_BLOCK" FROM legs""",
    legs=True,
)
def hour_block(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf, carrier=False, origin=False, dest=False)
    return df.select("l_orderkey", "l_partkey", C.hour_block("CRS_DEP_TIME").alias("CRS_DEP_TIME_BLOCK"))


@query(
    """SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS log_balance FROM customer"""
)
def signed_log_values(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return rounded(customer.select("c_custkey", signed_log("c_acctbal").alias("log_balance")), "log_balance")


# ---------------------------------------------------------------- graph

_EDGES = 'edges AS (SELECT "ORIGIN" AS src, "DEST" AS dst, count(*) AS weight FROM legs GROUP BY 1, 2)'
_ROUNDS = 25  # in SQL, well past what the ranks need to settle
_SETTLED = 1e-9


def _rank_sql(rounds: int = _ROUNDS) -> str:
    """Unrolled power iteration; places without outgoing routes spread their rank evenly."""
    head = f"""{_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    flow AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges),
    cnt AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, cnt)"""
    for i in range(rounds):
        head += f""", r{i + 1} AS MATERIALIZED (SELECT nodes.node, 0.15 / any_value(n) + 0.85 * coalesce(sum(r * p), 0) + 0.85 / any_value(n) *
      coalesce((SELECT sum(r) FROM r{i} WHERE node NOT IN (SELECT src FROM edges)), 0) AS r
      FROM nodes CROSS JOIN cnt LEFT JOIN flow ON flow.dst = nodes.node LEFT JOIN r{i} ON r{i}.node = flow.src GROUP BY 1)"""
    return head


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.weighted_edges(legs(spark, sf), "ORIGIN", "DEST")


@query(f"WITH {_EDGES} SELECT * FROM edges", legs=True)
def route_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query(
    f"""WITH {_EDGES}, e AS (SELECT src AS node, 0 AS i, weight AS o FROM edges UNION ALL SELECT dst, weight, 0 FROM edges)
    SELECT node, CAST(sum(i) AS DOUBLE) AS in_degree, CAST(sum(o) AS DOUBLE) AS out_degree FROM e GROUP BY 1""",
    legs=True,
)
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_edges(spark, sf))


@query(f"WITH {_rank_sql()} SELECT node, round(r, 8) AS pagerank FROM r{_ROUNDS}", legs=True)
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    ranks = G.pagerank(_edges(spark, sf), tol=_SETTLED)
    return rounded(ranks, "pagerank", digits=8)


@query(f"WITH {_rank_sql()} SELECT node, round(r, 6) AS pagerank FROM r{_ROUNDS}", name="pagerank_to_tolerance", legs=True)
def pagerank_to_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Iterated until the summed change falls below nodes * 1e-6."""
    return rounded(G.pagerank(_edges(spark, sf)), "pagerank", digits=6)


_FEATURES = ["origin_pagerank", "dest_pagerank", "origin_out_degree", "dest_in_degree"]
_NODE_SQL = f"""{_rank_sql()}, m AS (SELECT r{_ROUNDS}.node, r, (SELECT sum(weight) FROM edges WHERE dst = r{_ROUNDS}.node) AS i,
      (SELECT sum(weight) FROM edges WHERE src = r{_ROUNDS}.node) AS o FROM r{_ROUNDS})"""


def _with_graph(spark: SparkSession, sf: str) -> DataFrame:
    df = legs(spark, sf)
    nodes = G.node_metrics(G.weighted_edges(df, "ORIGIN", "DEST"), tol=_SETTLED)
    return G.attach_graph_features(df, nodes, "ORIGIN", "DEST")


@query(
    f"""WITH {_NODE_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a.r, 8) AS origin_pagerank,
      round(b.r, 8) AS dest_pagerank, CAST(a.o AS DOUBLE) AS origin_out_degree, CAST(b.i AS DOUBLE) AS dest_in_degree
    FROM legs LEFT JOIN m a ON "ORIGIN" = a.node LEFT JOIN m b ON "DEST" = b.node""",
    legs=True,
)
def graph_features(spark: SparkSession, sf: str) -> DataFrame:
    out = _with_graph(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_FEATURES)
    return rounded(out, *_FEATURES[:2], digits=8)


@query(
    f"""WITH {_NODE_SQL} SELECT m.node AS "Airport", round(CASE WHEN o > 0 THEN r END, 8) AS origin_pagerank,
      CAST(o * o AS DOUBLE) AS "OutDegree", round(CASE WHEN i > 0 THEN r END, 8) AS dest_pagerank,
      CAST(i * i AS DOUBLE) AS "InDegree" FROM m""",
    legs=True,
)
def airport_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rank and summed degree per place (a degree summed over its own rows is its square)."""
    return rounded(eda.airport_importance(_with_graph(spark, sf)), "origin_pagerank", "dest_pagerank", digits=8)


@query(
    f"""WITH {_rank_sql()}, top AS (SELECT node FROM r{_ROUNDS} ORDER BY r DESC, node LIMIT 10)
    SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)""",
    legs=True,
)
def top_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Routes among the ten places of highest rank."""
    edges = _edges(spark, sf)
    return G.top_subgraph(edges, G.pagerank(edges, tol=_SETTLED), "pagerank", 10)


# ---------------------------------------------------------------- splits and sampling


@query(
    """SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM orders
    WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '2000-01-01'"""
)
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    bounds = SP.holdout_for("all", dt.date(1995, 1, 1))
    return SP.apply_holdout(table(spark, sf, "orders"), "o_orderdate", bounds).select("o_orderkey", "split")


_FOLDS = """f AS (SELECT row_number() OVER (ORDER BY k) AS fold, v - INTERVAL 24 MONTH AS a, v AS b, v + INTERVAL 12 MONTH AS c
      FROM (SELECT k, mn + to_months(CAST(24 + 12 * k AS INTEGER)) AS v, mx FROM range(50) t(k),
        (SELECT CAST(min(o_orderdate) AS DATE) AS mn, CAST(max(o_orderdate) AS DATE) AS mx FROM orders))
      WHERE v + INTERVAL 12 MONTH <= mx + INTERVAL 1 DAY)"""


@query(
    f"""WITH {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CAST(a AS DATE) AS train_start, CAST(b AS DATE) AS val_start,
    CAST(c AS DATE) AS val_end FROM f"""
)
def rolling_bounds(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return SP.fold_bounds(orders, SP.rolling_folds(*SP.day_range(orders, "o_orderdate"), SP.fold_spec_for("all")))


@query(
    f"""WITH {_FOLDS} SELECT o_orderkey, CAST(fold AS INTEGER) AS fold,
      CASE WHEN o_orderdate < b THEN 'train' ELSE 'val' END AS role
    FROM orders JOIN f ON o_orderdate >= a AND o_orderdate < c"""
)
def rolling_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Two years of training, one of validation, moved on by a year, as one long table."""
    orders = table(spark, sf, "orders")
    folds = SP.rolling_folds(*SP.day_range(orders, "o_orderdate"), SP.fold_spec_for("all"))
    return SP.assign_folds(orders, "o_orderdate", folds).select("o_orderkey", "fold", "role")


_HASH = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    f"""WITH c AS (SELECT count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) AS keep FROM labels)
    SELECT doc_id, 1 - quality AS label FROM labels, c WHERE quality = 0 OR {_HASH.format(k='doc_id')} < keep"""
)
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    """The rare quality 0 as positives; the majority is sampled down to its number."""
    df = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return SP.downsample(df, "label", "doc_id")


@query(f"SELECT event_id, value FROM events WHERE {_HASH.format(k='event_id')} < 0.3")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return SP.hash_sample(table(spark, sf, "events").select("event_id", "value"), "event_id", 0.3)


@query(
    """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
    SELECT doc_id, labels.quality, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight
    FROM labels JOIN c ON labels.quality = c.quality"""
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "labels").select("doc_id", "quality")
    return rounded(SP.add_class_weights(df, "quality"), "weight")


@query(
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN 'train'
      WHEN year(o_orderdate) = 1998 THEN 'val' ELSE 'test' END AS split
    FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1999"""
)
def year_split(spark: SparkSession, sf: str) -> DataFrame:
    roles = {"train": (1995, 1997), "val": (1998, 1998), "test": (1999, 1999)}
    return SP.year_split(table(spark, sf, "orders"), "o_orderdate", roles).select("o_orderkey", "split")

"""The composite jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.plans import dataset, features, quality
from punctual.queries.registry import query
from punctual.queries.values import _utc_sql, hhmm_sql
from punctual.queries.views import OBS, TRIPS, obs, trips, with_views
from punctual.sources.weather import clean_weather

# --- trips as flights, observations as station reports, airports as stations -----------------


def flights(spark, sf_dir):
    t = trips(spark, sf_dir)
    k = F.col("trip_id")
    return t.select(
        F.col("trip_date").alias("FlightDate"), F.col("carrier").alias("Reporting_Airline"),
        F.col("tail").alias("Tail_Number"), k.cast("int").alias("Flight_Number_Reporting_Airline"),
        F.col("origin").alias("Origin"), F.col("dest").alias("Dest"),
        F.col("dep_hhmm").alias("CRSDepTime"), F.lpad(((k * 53) % 2400).cast("string"), 4, "0").alias("CRSArrTime"),
        F.col("dep_delay").alias("DepDelay"), F.when(k % 17 != 0, F.col("dep_delay") - 5).alias("ArrDelay"),
        F.col("distance").cast("double").alias("Distance"), F.lit(0.0).alias("Cancelled"),
    )


def mapping(spark, sf_dir):
    """One row per airport that occurs, with its station and zone; one airport lacks a station."""
    t = trips(spark, sf_dir)
    number = F.substring("airport", 2, 2).cast("int")
    zones = F.array(F.lit("America/New_York"), F.lit("America/Chicago"), F.lit("America/Denver"), F.lit("America/Los_Angeles"))
    airports = t.select(F.col("origin").alias("airport")).unionAll(t.select("dest")).distinct()
    return airports.select(
        "airport", F.when(number != 7, F.concat(F.lit("0"), "airport")).alias("station_id"),
        F.get(zones, number % 4).alias("timezone"), F.when(number == 7, "unmatched").otherwise("high").alias("mapping_confidence"),
    )


def reports(spark, sf_dir):
    raw = obs(spark, sf_dir).select(
        F.concat(F.lit("0"), "station").alias("STATION"), F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DATE"),
        F.when(F.col("obs_id") % 3 == 0, "FM-15").otherwise("FM-16").alias("REPORT_TYPE"), F.col("tmp_raw").alias("TMP"),
        F.concat(F.lit("-"), F.lpad((F.col("obs_id") % 200).cast("string"), 4, "0"), F.lit(",1")).alias("DEW"),
        F.concat(F.lit("01,"), F.lpad((F.col("obs_id") % 40).cast("string"), 4, "0"), F.lit(",9")).alias("AA1"),
    )
    return clean_weather(raw)


_ZONE = """CASE CAST(substr({a}, 2, 2) AS INTEGER) % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
      WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END"""
_STATION = "CASE WHEN {a} <> 'A07' THEN '0' || {a} END"
_ARR = "lpad(CAST((trip_id * 53) % 2400 AS VARCHAR), 4, '0')"

FLIGHTS = f"""
f0 AS (
  SELECT *, {hhmm_sql("dep_hhmm")} AS dep_min, {hhmm_sql(_ARR)} AS arr_min, {_ZONE.format(a="origin")} AS oz, {_ZONE.format(a="dest")} AS dz,
         {_STATION.format(a="origin")} AS os, {_STATION.format(a="dest")} AS ds, CASE WHEN trip_id % 17 <> 0 THEN dep_delay - 5 END AS arr_delay
  FROM trips
), f1 AS (
  SELECT *, CAST(trip_date AS TIMESTAMP) + to_minutes(dep_min) AS dl, CAST(trip_date AS TIMESTAMP) + to_minutes(arr_min) AS al FROM f0
), f2 AS (SELECT *, {_utc_sql("dl", "oz")} AS dep_utc, {_utc_sql("al", "dz")} AS arr0 FROM f1
), f3 AS (
  SELECT *, CASE WHEN arr0 < dep_utc - INTERVAL 2 HOUR THEN {_utc_sql("(al + INTERVAL 1 DAY)", "dz")} ELSE arr0 END AS arr_utc FROM f2
), w AS (
  SELECT '0' || station AS station_id, obs_ts, obs_id % 3 = 0 AS routine,
         CASE WHEN tmp_raw IS NULL OR tmp_raw = '+9999,9' THEN NULL ELSE CAST(split_part(tmp_raw, ',', 1) AS DOUBLE) / 10 END AS temp,
         -CAST(obs_id % 200 AS DOUBLE) / 10 AS dew, CAST(obs_id % 40 AS DOUBLE) / 10 AS precip
  FROM obs
)"""


def _matched(where: str = "") -> str:
    w = f"(SELECT * FROM w {where})"
    near = lambda o, t, c: f"CASE WHEN {o}.obs_ts >= {t} - INTERVAL 3 HOUR THEN {c} END"
    humid = "100 * exp(17.625 * {o}.dew / (243.04 + {o}.dew)) / exp(17.625 * {o}.temp / (243.04 + {o}.temp))"
    return f"""
f4 AS (
  SELECT f3.*, {near("o", "dep_utc", "o.temp")} AS origin_temp, {near("o", "dep_utc", "o.precip")} AS origin_precip,
         {near("o", "dep_utc", "epoch(o.obs_ts)")} AS origin_obs
  FROM f3 ASOF LEFT JOIN {w} o ON f3.os = o.station_id AND f3.dep_utc >= o.obs_ts
), f5 AS (
  SELECT f4.*, {near("o", "arr_utc", humid.format(o="o"))} AS dest_humidity, {near("o", "arr_utc", "epoch(o.obs_ts)")} AS dest_obs
  FROM f4 ASOF LEFT JOIN {w} o ON f4.ds = o.station_id AND f4.arr_utc >= o.obs_ts
)"""


def _mean_sql(keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY dep_utc NULLS LAST, carrier, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"round(CAST(sum(coalesce(CAST(dep_delay AS DECIMAL(18,2)), 0)) OVER {w} AS DOUBLE) / nullif(count(*) OVER {w}, 0), 12)"


_TABLE_SQL = f"""
SELECT CAST(trip_id AS INTEGER) AS flight, route, CAST(dep_min // 60 AS DOUBLE) AS dep_hour, CAST(arr_min // 60 AS DOUBLE) AS arr_hour,
       isodow(trip_date) AS weekday, CASE WHEN dep_delay >= 15 THEN 1 ELSE 0 END AS dep_late, CASE WHEN arr_delay >= 15 THEN 1 ELSE 0 END AS arr_late,
       CAST(epoch(dep_utc) AS DOUBLE) AS dep_s, CAST(epoch(arr_utc) AS DOUBLE) AS arr_s, os AS origin_station, ds AS dest_station,
       origin_temp, origin_precip, CAST(floor(origin_obs) AS DOUBLE) AS origin_obs_s, round(dest_humidity, 6) AS dest_humidity, CAST(floor(dest_obs) AS DOUBLE) AS dest_obs_s,
       {_mean_sql("origin, isodow(trip_date), dep_min // 60")} AS origin_prior, {_mean_sql("carrier, route")} AS route_prior,
       row_number() OVER (PARTITION BY origin, date_trunc('hour', dep_utc) ORDER BY dep_utc NULLS LAST, carrier, trip_id) - 1 AS congestion,
       CASE WHEN tail IS NOT NULL THEN lag(arr_delay) OVER (PARTITION BY tail ORDER BY dep_utc NULLS LAST, carrier, trip_id) END AS leg
FROM f5"""


def _table_view(m):
    seconds = lambda c: F.floor(F.unix_micros(c) / 1000000).cast("double").alias
    return m.select(
        F.col("Flight_Number_Reporting_Airline").alias("flight"), "route",
        F.col("scheduled_departure_hour_local").cast("double").alias("dep_hour"),
        F.col("scheduled_arrival_hour_local").cast("double").alias("arr_hour"),
        F.col("day_of_week").cast("bigint").alias("weekday"), F.col("dep_delayed_15").alias("dep_late"), F.col("arr_delayed_15").alias("arr_late"),
        seconds("sched_dep_utc")("dep_s"), seconds("sched_arr_utc")("arr_s"),
        F.col("origin_station_id").alias("origin_station"), F.col("dest_station_id").alias("dest_station"),
        F.col("origin_temp_c").alias("origin_temp"), F.col("origin_precip_mm").alias("origin_precip"),
        seconds("origin_weather_timestamp_utc")("origin_obs_s"), F.round("dest_humidity_pct", 6).alias("dest_humidity"),
        seconds("dest_weather_timestamp_utc")("dest_obs_s"), F.round("origin_hourly_avg_dep_delay_prior", 12).alias("origin_prior"),
        F.round("carrier_route_avg_dep_delay_prior", 12).alias("route_prior"),
        F.col("origin_hourly_congestion_proxy_prior").alias("congestion"), F.col("previous_leg_arr_delay_minutes").alias("leg"),
    )


@query("modeling_table", with_views(TRIPS, OBS, FLIGHTS, _matched()) + _TABLE_SQL)
def modeling_table(spark, sf_dir):
    m = dataset.build_modeling_table(flights(spark, sf_dir), reports(spark, sf_dir), mapping(spark, sf_dir))
    return _table_view(m)


@query("modeling_table_hot_key_path", with_views(TRIPS, OBS, FLIGHTS, _matched()) + _TABLE_SQL)
def modeling_table_hot_key_path(spark, sf_dir):
    """The same table by the path that large inputs take."""
    m = dataset.build_modeling_table(flights(spark, sf_dir), reports(spark, sf_dir), mapping(spark, sf_dir), buckets=12)
    return _table_view(m)


@query("strict_modeling_table", with_views(TRIPS, OBS, FLIGHTS, _matched("WHERE routine")) + """
SELECT origin AS "Origin", count(*) AS flights, count(origin_temp) AS temps, count(dest_obs) AS dest_matches FROM f5 WHERE origin_obs IS NOT NULL GROUP BY 1""")
def strict_modeling_table(spark, sf_dir):
    m = dataset.build_modeling_table(flights(spark, sf_dir), reports(spark, sf_dir), mapping(spark, sf_dir), strict=True)
    return m.groupBy("Origin").agg(
        F.count(F.lit(1)).alias("flights"), F.count("origin_temp_c").alias("temps"),
        F.count("dest_weather_timestamp_utc").alias("dest_matches"),
    )


@query("schedule_timestamps", with_views(TRIPS, OBS, FLIGHTS) + """
SELECT CAST(trip_id AS INTEGER) AS flight, CAST(epoch(dep_utc) AS DOUBLE) AS dep_s, CAST(epoch(arr_utc) AS DOUBLE) AS arr_s, month(trip_date) AS month, route FROM f3""")
def schedule_timestamps(spark, sf_dir):
    p = dataset.prepare_timestamps(flights(spark, sf_dir), mapping(spark, sf_dir))
    return p.select(
        F.col("Flight_Number_Reporting_Airline").alias("flight"), F.unix_seconds("sched_dep_utc").cast("double").alias("dep_s"),
        F.unix_seconds("sched_arr_utc").cast("double").alias("arr_s"), F.col("month").cast("bigint").alias("month"), "route",
    )


@query("dataset_quality", with_views(TRIPS, OBS, FLIGHTS, _matched()) + """
SELECT 'modeling_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM f5
UNION ALL SELECT 'origin_weather_join_rate', round(avg(CASE WHEN origin_temp IS NULL THEN 0 ELSE 1 END), 6) FROM f5
UNION ALL SELECT 'dep_positive_share', round(avg(delayed), 6) FROM f5
UNION ALL SELECT 'malformed_CRSDepTime', CAST(count(*) - count(dep_min) AS DOUBLE) FROM f5
UNION ALL SELECT 'malformed_CRSArrTime', CAST(count(*) - count(arr_min) AS DOUBLE) FROM f5
UNION ALL SELECT 'missing_share_DepDelay', round(avg(CASE WHEN dep_delay IS NULL THEN 1 ELSE 0 END), 6) FROM f5
UNION ALL SELECT 'missing_share_ArrDelay', round(avg(CASE WHEN arr_delay IS NULL THEN 1 ELSE 0 END), 6) FROM f5
UNION ALL SELECT 'duplicate_flights', CAST(0 AS DOUBLE)
UNION ALL SELECT 'missing_station_mappings', CAST(1 AS DOUBLE)""")
def dataset_quality(spark, sf_dir):
    f, m, w = flights(spark, sf_dir), mapping(spark, sf_dir), reports(spark, sf_dir)
    overview = quality.quality_report(f, m, w, dataset.build_modeling_table(f, w, m))["overview"]
    skip = ["flights_rows", "weather_rows", "dest_weather_join_rate", "arr_positive_share"]
    return overview.where(~F.col("metric").isin(*skip)).withColumn("value", F.round("value", 6))


# --- feature frame ---------------------------------------------------------------------------
def analysis_table(spark, sf_dir):
    """Trips as a packaged modelling table that lacks some columns."""
    t = trips(spark, sf_dir)
    return t.select(
        F.col("trip_date").alias("FlightDate"), F.col("carrier").alias("Reporting_Airline"), F.col("origin").alias("Origin"),
        F.col("dest").alias("Dest"), F.col("distance").cast("double").alias("Distance"),
        F.hour("dep_ts").alias("scheduled_departure_hour_local"), F.col("dep_delay").alias("dep_delay_minutes"),
        F.col("delayed").alias("dep_delayed_15"), F.col("dep_ts").alias("sched_dep_utc"),
        *[F.lit(None).cast("double").alias(c) for c in (
            "origin_hourly_avg_dep_delay_prior", "carrier_route_avg_dep_delay_prior", "origin_hourly_congestion_proxy_prior",
            "origin_temp_c", "origin_wind_speed_mps", "origin_humidity_pct", "origin_ceiling_m",
        )],
        F.when(F.col("distance") < 60, F.col("distance") * 100.0).alias("origin_visibility_m"),
        F.when(F.col("distance") < 12, F.col("distance").cast("double")).alias("origin_precip_mm"), "trip_id",
    )


_HOUR_DELAY = "CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay)"


def _hourly(key: str) -> str:
    return f"""SELECT {key}, h, lag(d) OVER (PARTITION BY {key} ORDER BY h) AS pd,
         avg(r) OVER (PARTITION BY {key} ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pr
    FROM (SELECT {key}, h, {_HOUR_DELAY} AS d, avg(delayed) AS r FROM a GROUP BY 1, 2)"""


FEATURES = f"""
a AS (SELECT *, date_trunc('hour', dep_ts) AS h, CASE WHEN distance < 12 THEN CAST(distance AS DOUBLE) ELSE 0 END AS precip,
             CASE WHEN hour(dep_ts) BETWEEN 6 AND 9 THEN 1 ELSE 0 END AS peak FROM trips WHERE dep_delay IS NOT NULL),
ho AS ({_hourly("origin")}), hc AS ({_hourly("carrier")}), hr AS ({_hourly("route")}),
feature_rows AS (
  SELECT a.*, round(ho.pd, 12) AS origin_prev, round(ho.pr, 6) AS origin_rate, round(hc.pd, 12) AS carrier_prev, round(hc.pr, 6) AS carrier_rate,
         round(hr.pd, 12) AS route_prev, precip * peak AS wet_peak,
         round(CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) OVER pw AS DOUBLE) / nullif(count(*) OVER pw, 0), 12) AS pair_prior
  FROM a LEFT JOIN ho ON ho.origin = a.origin AND ho.h = a.h LEFT JOIN hc ON hc.carrier = a.carrier AND hc.h = a.h
  LEFT JOIN hr ON hr.route = a.route AND hr.h = a.h
  WINDOW pw AS (PARTITION BY a.origin, a.carrier ORDER BY dep_ts, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


@query("feature_frame", with_views(TRIPS, FEATURES) + """
SELECT trip_id, CAST(isodow(trip_date) AS DOUBLE) AS weekday, CASE WHEN isodow(trip_date) >= 6 THEN 1 ELSE 0 END AS weekend, peak,
       CASE WHEN trip_date IN (DATE '2024-01-01', DATE '2024-01-15') THEN 1 ELSE 0 END AS holiday, 'winter' AS season,
       origin_prev, origin_rate, carrier_prev, carrier_rate, route_prev, pair_prior, precip, CAST(wet_peak AS DOUBLE) AS wet_peak,
       CASE WHEN dep_delay < 0 THEN 0.0 ELSE dep_delay END AS late_minutes FROM feature_rows""")
def feature_frame(spark, sf_dir):
    built = features.build_feature_frame(features.analysis_frame(analysis_table(spark, sf_dir)))
    r = lambda c, n, digits=12: F.round(c, digits).alias(n)
    return built.frame.select(
        "trip_id", F.col("day_of_week").alias("weekday"), F.col("is_weekend").alias("weekend"), F.col("peak_hour").alias("peak"),
        F.col("is_holiday").alias("holiday"), "season", r("origin_avg_dep_delay_prev_hour", "origin_prev"),
        r("origin_delay_rate_prev_3h", "origin_rate", 6), r("carrier_avg_dep_delay_prev_hour", "carrier_prev"),
        r("carrier_delay_rate_prev_3h", "carrier_rate", 6), r("route_avg_dep_delay_prev_hour", "route_prev"),
        r("airport_carrier_avg_dep_delay_prior", "pair_prior"), F.col("origin_precip_mm").alias("precip"),
        F.col("precip_peak_interaction").cast("double").alias("wet_peak"), F.col("dep_delay_minutes_late_only").alias("late_minutes"),
    )


@query("model_frames", with_views(TRIPS, FEATURES) + """
, top AS (SELECT origin FROM feature_rows GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 20),
kept AS (SELECT * FROM feature_rows WHERE origin IN (SELECT origin FROM top)),
d AS (SELECT trip_date AS d, row_number() OVER (ORDER BY trip_date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT trip_date FROM kept)),
c AS (SELECT d AS cut FROM d WHERE pos = greatest(CAST(floor(n * 0.8) AS BIGINT), 1))
SELECT CASE WHEN trip_date < cut THEN 'train' ELSE 'test' END AS role, strftime(cut, '%Y-%m-%d') AS cut, count(*) AS rows, sum(delayed)::BIGINT AS positives,
       round(avg(ln(1 + precip)), 6) AS log_precip FROM kept, c GROUP BY 1, 2""")
def model_frames(spark, sf_dir):
    """Busiest origins, split, log twins, live features: what every model trains on."""
    got = features.build_model_frames(
        features.analysis_frame(analysis_table(spark, sf_dir)), top_origins=20, identity=["trip_id"]
    )
    if "log1p_origin_precip_mm" not in got.features.numeric or "origin_temp_c" in got.features.numeric:
        raise AssertionError(f"unexpected features {got.features.numeric}")
    parts = [
        f.agg(
            F.count(F.lit(1)).alias("rows"), F.sum("dep_delayed_15").alias("positives"),
            F.round(F.avg("log1p_origin_precip_mm"), 6).alias("log_precip"),
        ).select(F.lit(n).alias("role"), F.lit(str(got.cut)).alias("cut"), "*")
        for n, f in (("train", got.train), ("test", got.test))
    ]
    return parts[0].unionByName(parts[1])


@query("preprocessing_summary", with_views(TRIPS, FEATURES) + """
SELECT 'route_avg_dep_delay_prev_hour' AS feature, round(avg(CASE WHEN route_prev IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate FROM feature_rows
UNION ALL SELECT 'origin_visibility_m', round(avg(CASE WHEN distance >= 60 THEN 1 ELSE 0 END), 6) FROM feature_rows
UNION ALL SELECT 'origin_avg_dep_delay_prev_hour', round(avg(CASE WHEN origin_prev IS NULL THEN 1 ELSE 0 END), 6) FROM feature_rows
UNION ALL SELECT 'precip_peak_interaction', CAST(0 AS DOUBLE)""")
def preprocessing_summary(spark, sf_dir):
    built = features.build_feature_frame(features.analysis_frame(analysis_table(spark, sf_dir)))
    names = ["route_avg_dep_delay_prev_hour", "origin_visibility_m", "origin_avg_dep_delay_prev_hour", "precip_peak_interaction"]
    parts = quality.preprocessing_summary(built.frame, built.frame, names, names)
    return parts["missing"].withColumn("missing_rate", F.round("missing_rate", 6))


@query("table_summary", with_views(TRIPS, FEATURES) + """
SELECT 'feature_rows' AS dataset, count(*) AS rows, round(avg(delayed), 6) AS delay_rate, round(avg(CASE WHEN distance < 60 THEN 1 ELSE 0 END), 6) AS present_origin_visibility_m,
       round(avg(CASE WHEN precip > 0 THEN delayed END), 6) AS bad_weather_delay_rate, round(avg(CASE WHEN hour(dep_ts) BETWEEN 17 AND 22 THEN delayed END), 6) AS evening_delay_rate
FROM feature_rows""")
def table_summary(spark, sf_dir):
    built = features.build_feature_frame(features.analysis_frame(analysis_table(spark, sf_dir)))
    out = quality.dataset_summary(built.frame, "feature_rows")
    names = ["delay_rate", "present_origin_visibility_m", "bad_weather_delay_rate", "evening_delay_rate"]
    return out.select("dataset", "rows", *[F.round(c, 6).alias(c) for c in names])



"""Table contracts.

Fixed values: the column names, their order and the missing-value markers below
must equal the published data formats, so they are spelled out as they are.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw trip records -------------------------------------------------
FLIGHT_COLUMNS = [
    ("Year", "int"), ("Quarter", "int"), ("Month", "int"), ("DayofMonth", "int"),
    ("DayOfWeek", "int"), ("FlightDate", "string"), ("Reporting_Airline", "string"),
    ("DOT_ID_Reporting_Airline", "int"), ("IATA_CODE_Reporting_Airline", "string"),
    ("Tail_Number", "string"), ("Flight_Number_Reporting_Airline", "int"),
    ("OriginAirportID", "int"), ("OriginAirportSeqID", "int"), ("OriginCityMarketID", "int"),
    ("Origin", "string"), ("OriginCityName", "string"), ("OriginState", "string"),
    ("OriginStateName", "string"), ("DestAirportID", "int"), ("DestAirportSeqID", "int"),
    ("DestCityMarketID", "int"), ("Dest", "string"), ("DestCityName", "string"),
    ("DestState", "string"), ("DestStateName", "string"), ("CRSDepTime", "string"),
    ("DepTime", "string"), ("DepDelay", "double"), ("DepDelayMinutes", "double"),
    ("DepDel15", "double"), ("TaxiOut", "double"), ("WheelsOff", "string"),
    ("WheelsOn", "string"), ("TaxiIn", "double"), ("CRSArrTime", "string"),
    ("ArrTime", "string"), ("ArrDelay", "double"), ("ArrDelayMinutes", "double"),
    ("ArrDel15", "double"), ("Cancelled", "double"), ("CancellationCode", "string"),
    ("Diverted", "double"), ("CRSElapsedTime", "double"), ("ActualElapsedTime", "double"),
    ("AirTime", "double"), ("Distance", "double"), ("CarrierDelay", "double"),
    ("WeatherDelay", "double"), ("NASDelay", "double"), ("SecurityDelay", "double"),
    ("LateAircraftDelay", "double"),
]
FLIGHT_HEADER_FIXES = {
    "DOT_ID_Reporting_Airline ": "DOT_ID_Reporting_Airline",
    "Flight_Number_Reporting_Airline ": "Flight_Number_Reporting_Airline",
}
FLIGHT_CODE_COLUMNS = ["Reporting_Airline", "Origin", "Dest", "OriginState", "DestState"]
FLIGHT_DUPLICATE_KEY = [
    "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest", "CRSDepTime",
]
FLIGHT_SORT = ["FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime"]

# --- fixed values: raw station reports ----------------------------------------------
WEATHER_RAW_COLUMNS = [
    "STATION", "DATE", "NAME", "LATITUDE", "LONGITUDE", "REPORT_TYPE", "SOURCE", "CALL_SIGN",
    "TMP", "DEW", "WND", "VIS", "CIG", "SLP",
    "AA1", "AA2", "AA3", "AA4", "AW1", "AW2", "AW3", "AW4", "MW1", "MW2", "MW3", "MW4",
]
DEFAULT_MARKERS = ("9999", "99999", "999999")
# name: (source field, part, scale, markers)
WEATHER_MEASURES = {
    "temperature_c": ("TMP", 0, 10.0, DEFAULT_MARKERS),
    "dew_point_c": ("DEW", 0, 10.0, DEFAULT_MARKERS),
    "wind_speed_mps": ("WND", 3, 10.0, DEFAULT_MARKERS),
    "wind_direction_deg": ("WND", 0, 1.0, ("999", "9999")),
    "visibility_m": ("VIS", 0, 1.0, ("999999", "99999")),
    "sea_level_pressure_hpa": ("SLP", 0, 10.0, DEFAULT_MARKERS),
    "ceiling_m": ("CIG", 0, 1.0, ("99999", "999999")),
}
PRECIP_FIELDS = ["AA1", "AA2", "AA3", "AA4"]
CODE_FIELDS = ["AW1", "AW2", "AW3", "AW4", "MW1", "MW2", "MW3", "MW4"]
WEATHER_COLUMNS = [
    ("station_id", "string"), ("timestamp_utc", "timestamp"), ("station_name", "string"),
    ("station_latitude", "double"), ("station_longitude", "double"), ("report_type", "string"),
    ("source", "string"), ("call_sign", "string"), ("temperature_c", "double"),
    ("dew_point_c", "double"), ("wind_speed_mps", "double"), ("wind_direction_deg", "double"),
    ("visibility_m", "double"), ("sea_level_pressure_hpa", "double"), ("precip_mm", "double"),
    ("weather_code", "string"), ("relative_humidity_pct", "double"), ("ceiling_m", "double"),
]
# output suffix of the matched observation: source measure
WEATHER_PAYLOAD = {
    "weather_timestamp_utc": "timestamp_utc",
    "temp_c": "temperature_c",
    "dew_point_c": "dew_point_c",
    "wind_speed_mps": "wind_speed_mps",
    "wind_direction_deg": "wind_direction_deg",
    "visibility_m": "visibility_m",
    "sea_level_pressure_hpa": "sea_level_pressure_hpa",
    "precip_mm": "precip_mm",
    "weather_code": "weather_code",
    "humidity_pct": "relative_humidity_pct",
    "ceiling_m": "ceiling_m",
}
STRICT_REPORT_TYPE = "FM-15"

# --- fixed values: station list and mapping -----------------------------------------
STATION_RENAMES = {
    "STATION_NAME": "station_name", "CTRY": "country", "STATE": "state", "ICAO": "icao",
    "CALL": "call", "USAF": "usaf", "WBAN": "wban", "LAT": "latitude", "LON": "longitude",
    "ELEV_M": "elevation_m", "BEGIN": "begin_date", "END": "end_date",
}
MAPPING_COLUMNS = [
    ("airport", "string"), ("state", "string"), ("station_id", "string"), ("station_name", "string"),
    ("distance_km", "double"), ("mapping_confidence", "string"), ("confidence_score", "double"),
    ("latitude", "double"), ("longitude", "double"), ("timezone", "string"), ("match_details", "string"),
]

# --- fixed values: modelling table ---------------------------------------------------
MODEL_COLUMNS = [
    ("FlightDate", "date"), ("Reporting_Airline", "string"), ("DOT_ID_Reporting_Airline", "int"),
    ("Tail_Number", "string"), ("Flight_Number_Reporting_Airline", "int"), ("Origin", "string"),
    ("Dest", "string"), ("route", "string"), ("Distance", "double"), ("CRSDepTime", "string"),
    ("CRSArrTime", "string"), ("scheduled_departure_hour_local", "int"),
    ("scheduled_arrival_hour_local", "int"), ("day_of_week", "int"), ("month", "int"),
    ("Cancelled", "double"), ("CancellationCode", "string"), ("Diverted", "double"),
    ("TaxiOut", "double"), ("TaxiIn", "double"), ("AirTime", "double"), ("dep_delay_minutes", "double"),
    ("arr_delay_minutes", "double"), ("dep_delayed_15", "int"), ("arr_delayed_15", "int"),
    ("previous_leg_delay_available", "int"), ("previous_leg_arr_delay_minutes", "double"),
    ("origin_hourly_avg_dep_delay_prior", "double"), ("carrier_route_avg_dep_delay_prior", "double"),
    ("origin_hourly_congestion_proxy_prior", "bigint"), ("origin_temp_c", "double"),
    ("origin_wind_speed_mps", "double"), ("origin_visibility_m", "double"), ("origin_precip_mm", "double"),
    ("origin_weather_code", "string"), ("origin_dew_point_c", "double"), ("origin_humidity_pct", "double"),
    ("origin_ceiling_m", "double"), ("dest_temp_c", "double"), ("dest_wind_speed_mps", "double"),
    ("dest_visibility_m", "double"), ("dest_precip_mm", "double"), ("dest_weather_code", "string"),
    ("dest_dew_point_c", "double"), ("dest_humidity_pct", "double"), ("dest_ceiling_m", "double"),
    ("origin_station_id", "string"), ("dest_station_id", "string"), ("sched_dep_utc", "timestamp"),
    ("sched_arr_utc", "timestamp"), ("origin_weather_timestamp_utc", "timestamp"),
    ("dest_weather_timestamp_utc", "timestamp"),
]

# --- fixed values: analysis table and features --------------------------------------
ANALYSIS_COLUMNS = [
    ("FlightDate", "date"), ("Reporting_Airline", "string"), ("Origin", "string"), ("Dest", "string"),
    ("route", "string"), ("Distance", "double"), ("scheduled_departure_hour_local", "double"),
    ("scheduled_arrival_hour_local", "double"), ("day_of_week", "double"), ("month", "double"),
    ("dep_delay_minutes", "double"), ("arr_delay_minutes", "double"), ("dep_delayed_15", "double"),
    ("previous_leg_delay_available", "double"), ("previous_leg_arr_delay_minutes", "double"),
    ("origin_hourly_avg_dep_delay_prior", "double"), ("carrier_route_avg_dep_delay_prior", "double"),
    ("origin_hourly_congestion_proxy_prior", "double"), ("origin_temp_c", "double"),
    ("origin_wind_speed_mps", "double"), ("origin_visibility_m", "double"), ("origin_precip_mm", "double"),
    ("origin_dew_point_c", "double"), ("origin_humidity_pct", "double"), ("origin_ceiling_m", "double"),
    ("dest_temp_c", "double"), ("dest_wind_speed_mps", "double"), ("dest_visibility_m", "double"),
    ("dest_precip_mm", "double"), ("dest_dew_point_c", "double"), ("dest_humidity_pct", "double"),
    ("dest_ceiling_m", "double"), ("sched_dep_utc", "timestamp"), ("origin_weather_timestamp_utc", "timestamp"),
]
CATEGORICAL_FEATURES = ["Reporting_Airline", "Origin", "Dest", "season"]
NUMERIC_FEATURES = [
    "scheduled_departure_hour_local", "scheduled_arrival_hour_local", "day_of_week", "month",
    "is_weekend", "is_holiday", "peak_hour", "Distance", "previous_leg_delay_available",
    "previous_leg_arr_delay_minutes", "origin_hourly_avg_dep_delay_prior",
    "carrier_route_avg_dep_delay_prior", "origin_hourly_congestion_proxy_prior", "origin_temp_c",
    "origin_wind_speed_mps", "origin_visibility_m", "origin_precip_mm", "origin_dew_point_c",
    "origin_humidity_pct", "origin_ceiling_m", "dest_temp_c", "dest_wind_speed_mps",
    "dest_visibility_m", "dest_precip_mm", "dest_dew_point_c", "dest_humidity_pct", "dest_ceiling_m",
    "origin_avg_dep_delay_prev_hour", "carrier_avg_dep_delay_prev_hour", "route_avg_dep_delay_prev_hour",
    "origin_delay_rate_prev_3h", "carrier_delay_rate_prev_3h", "airport_carrier_avg_dep_delay_prior",
    "precip_peak_interaction",
]
HEATMAP_COLUMNS = [
    "dep_delay_minutes_late_only", "origin_avg_dep_delay_prev_hour", "carrier_avg_dep_delay_prev_hour",
    "route_avg_dep_delay_prev_hour", "origin_delay_rate_prev_3h", "carrier_delay_rate_prev_3h",
    "airport_carrier_avg_dep_delay_prior", "origin_precip_mm", "origin_visibility_m", "origin_temp_c",
    "origin_humidity_pct", "Distance", "scheduled_departure_hour_local", "is_weekend", "is_holiday",
    "precip_peak_interaction",
]
PROMPT_FIELDS = [  # label in the text, column
    ("distance_miles", "Distance"), ("origin_temp_c", "origin_temp_c"),
    ("origin_visibility_m", "origin_visibility_m"), ("origin_wind_speed_mps", "origin_wind_speed_mps"),
    ("origin_precip_mm", "origin_precip_mm"), ("origin_ceiling_m", "origin_ceiling_m"),
    ("origin_humidity_pct", "origin_humidity_pct"),
    ("prior_origin_avg_delay", "origin_hourly_avg_dep_delay_prior"),
    ("prior_carrier_route_avg_delay", "carrier_route_avg_dep_delay_prior"),
    ("origin_congestion_proxy", "origin_hourly_congestion_proxy_prior"),
]


def struct_of(columns: list[tuple[str, str]]) -> T.StructType:
    """Schema for a list of (name, simple type) pairs."""
    return T._parse_datatype_string(", ".join(f"`{name}` {kind}" for name, kind in columns))


FLIGHT_SCHEMA = [name for name, _ in FLIGHT_COLUMNS]

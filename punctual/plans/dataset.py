"""Build of the modelling table: timestamps, labels, observations, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.contracts import MODEL_COLUMNS, STRICT_REPORT_TYPE, WEATHER_PAYLOAD
from punctual.functions.clock import (
    date_plus_minutes, hhmm_to_minutes, hour_of_minutes, instant_of, offsets_around, rolled_arrival, route_key, weekday_number,
)
from punctual.functions.values import threshold_label, to_number
from punctual.operators.history import previous_leg, prior_count_in_hour, prior_means
from punctual.operators.join import asof_join, attach_dimension
from punctual.operators.project import project_contract, require_weather_coverage
from punctual.session import staged

TOLERANCE = "3 HOURS"
TIE_ORDER = ["Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest"]


def prepare_timestamps(flights: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stations and zones of both ends, local and UTC schedule times, calendar parts, route."""
    df = flights
    for side, column in (("origin", "Origin"), ("dest", "Dest")):
        names = {"station_id": f"{side}_station_id", "timezone": f"{side}_timezone"}
        df = attach_dimension(df, mapping, column, "airport", names)
    day = F.col("FlightDate").cast("date")
    df = df.withColumns({
        "FlightDate": day,
        "crs_dep_minutes": hhmm_to_minutes(F.col("CRSDepTime")),
        "crs_arr_minutes": hhmm_to_minutes(F.col("CRSArrTime")),
    })
    df = df.withColumns({
        "sched_dep_local_naive": date_plus_minutes(F.col("FlightDate"), F.col("crs_dep_minutes")),
        "sched_arr_local_naive": date_plus_minutes(F.col("FlightDate"), F.col("crs_arr_minutes")),
    })
    ends = {"dep": (F.col("sched_dep_local_naive"), F.col("origin_timezone")), "arr": (F.col("sched_arr_local_naive"), F.col("dest_timezone"))}
    around = {end: offsets_around(local, zone) for end, (local, zone) in ends.items()}
    df = df.withColumns({f"__{end}_{i}": c for end, pair in around.items() for i, c in enumerate(pair)})
    df = df.withColumns({
        f"sched_{end}_utc": instant_of(local, zone, F.col(f"__{end}_0"), F.col(f"__{end}_1")) for end, (local, zone) in ends.items()
    }).drop(*[f"__{end}_{i}" for end in ends for i in (0, 1)])
    local, utc = rolled_arrival(
        F.col("sched_dep_utc"), F.col("sched_arr_utc"), F.col("sched_arr_local_naive"), F.col("dest_timezone")
    )
    return df.withColumns({"sched_arr_local_naive": local, "sched_arr_utc": utc}).withColumns({
        "scheduled_departure_hour_local": hour_of_minutes(F.col("crs_dep_minutes")),
        "scheduled_arrival_hour_local": hour_of_minutes(F.col("crs_arr_minutes")),
        "month": F.month("FlightDate"),
        "day_of_week": weekday_number(F.col("FlightDate")),
        "route": route_key(F.col("Origin"), F.col("Dest")),
    })


def add_labels(df: DataFrame) -> DataFrame:
    dep, arr = to_number(F.col("DepDelay")), to_number(F.col("ArrDelay"))
    return df.withColumns({
        "DepDelay": dep, "ArrDelay": arr, "dep_delay_minutes": dep, "arr_delay_minutes": arr,
        "dep_delayed_15": threshold_label(dep), "arr_delayed_15": threshold_label(arr),
    })


def attach_weather(
    df: DataFrame, weather: DataFrame, tolerance: str = TOLERANCE, buckets: int | None = None, mix: str | None = None
) -> DataFrame:
    """Latest observation at the origin before departure and at the destination before arrival.

    ``mix`` is a column of ``df`` with a hash of its rows (see ``asof_join``).
    """
    source = df
    for side, time in (("origin", "sched_dep_utc"), ("dest", "sched_arr_utc")):
        payload = {f"{side}_{suffix}": source for suffix, source in WEATHER_PAYLOAD.items()}
        df = asof_join(
            df, weather, f"{side}_station_id", "station_id", time, "timestamp_utc", payload, tolerance,
            buckets=buckets, source=source, mix=mix,
        )
    return df


def operational_features(
    df: DataFrame,
    tie_order: Sequence[str] = TIE_ORDER,
    reference_compat: bool = False,
    buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Prior means, rows so far in the hour, previous leg."""
    source = df if source is None else source
    time = "sched_dep_utc"
    ties = [c for c in tie_order if c in df.columns]
    df = prior_means(
        df, time, "DepDelay",
        {
            "origin_hourly_avg_dep_delay_prior": ["Origin", "day_of_week", "scheduled_departure_hour_local"],
            "carrier_route_avg_dep_delay_prior": ["Reporting_Airline", "route"],
        },
        ties, buckets=buckets, source=source,
    )
    df = prior_count_in_hour(
        df, time, "Origin", "origin_hourly_congestion_proxy_prior", ties, buckets=buckets, source=source
    )
    return previous_leg(
        df, time, "Tail_Number", "ArrDelay", "previous_leg_arr_delay_minutes", "previous_leg_delay_available",
        ties, reference_compat=reference_compat, buckets=buckets, source=source,
    )


def build_modeling_table(
    flights: DataFrame,
    weather: DataFrame,
    mapping: DataFrame,
    tie_order: Sequence[str] = TIE_ORDER,
    strict: bool = False,
    reference_compat: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Flights with labels, observations and history in the 52-column contract.

    ``strict`` matches only observations of the routine report type and keeps flights that
    have one.  Every ordered scan reads the prepared flights twice and both ends read the observations, so
    they are written once to the shared folder and scanned there, the flights with a hash of each row.  So is the
    mapping: joins then know its size beforehand and do not shuffle the flights to a small one.
    """
    if strict:
        weather = weather.where(F.trim("report_type") == STRICT_REPORT_TYPE)
    weather = staged(weather.select("station_id", *WEATHER_PAYLOAD.values()))
    mapping = staged(mapping.select("airport", "station_id", "timezone"))
    prepared = add_labels(prepare_timestamps(flights, mapping))
    prepared = staged(prepared.withColumn("__row_hash", F.xxhash64(*prepared.columns)))
    df = attach_weather(prepared, weather, buckets=buckets, mix="__row_hash").drop("__row_hash")
    df = operational_features(df, tie_order, reference_compat, buckets=buckets, source=prepared)
    if strict:
        df = require_weather_coverage(df)
    return project_contract(df, MODEL_COLUMNS)

"""Projections and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.clock import route_key, weekday_number
from punctual.functions.values import to_number


def require_columns(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The named columns first, absent ones as typed nulls, then whatever else there is."""
    have = set(df.columns)
    names = {n for n, _ in columns}
    wanted = [F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in columns]
    return df.select(*wanted, *[c for c in df.columns if c not in names])


def project_contract(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the contract's columns, in order and type; absent ones as null."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns])


def normalize_columns(
    df: DataFrame,
    columns: Sequence[tuple[str, str]],
    renames: dict[str, str],
    code_columns: Sequence[str],
    date_column: str,
) -> DataFrame:
    """Fix headers, add missing columns, parse the date, trim and upper-case the codes."""
    df = require_columns(df.withColumnsRenamed(renames), columns)
    changed = {c: F.upper(F.trim(F.col(c).cast("string"))) for c in code_columns if c in df.columns}
    changed[date_column] = F.col(date_column).try_cast("date")
    return df.withColumns(changed)


def filter_in(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is listed; an empty list keeps all.

    Listed values count as values of the column's type, whatever their number, and the filter is
    pushed into the scan.  A list that is itself a table comes as a DataFrame and is a semi join.
    """
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(values.select(F.col(key).alias(column)), column, "left_semi")
    if not values:
        return df
    kind = df.schema[column].dataType
    return df.where(F.col(column).isin(*[F.lit(v).try_cast(kind) for v in values if v is not None]))


def filter_date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included and both optional."""
    kind = df.schema[column].dataType.simpleString()
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if end:
        df = df.where(F.col(column) <= F.lit(end).cast(kind))
    return df


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def top_entities(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent non-null values; ties go to the smaller value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), column)
        .limit(n)
    )


def keep_top_entities(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the n most frequent entities; 0 keeps all.  The n-row side decides its own join."""
    if n <= 0:
        return df
    return df.join(top_entities(df, column, n).select(column), column, "left_semi")


def require_weather_coverage(
    df: DataFrame, time_column: str = "origin_weather_timestamp_utc"
) -> DataFrame:
    """Rows that matched an observation (observations are filtered by report type before the match)."""
    return df.where(F.col(time_column).isNotNull())


def non_null_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with at least one value, found in one pass."""
    if not columns:
        return []
    counts = df.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns if c in df.columns})


# fixed values: columns of the analysis table that may be absent
OPTIONAL_NUMERIC = [
    "arr_delay_minutes", "previous_leg_delay_available", "previous_leg_arr_delay_minutes", "dest_temp_c",
    "dest_wind_speed_mps", "dest_visibility_m", "dest_precip_mm", "dest_dew_point_c", "dest_humidity_pct",
    "dest_ceiling_m", "origin_dew_point_c", "month", "day_of_week",
]


def fallback_columns(df: DataFrame) -> DataFrame:
    """Stand-ins for columns an analysis table may lack."""
    have = set(df.columns)
    add: dict[str, Column] = {}
    if "route" not in have and {"Origin", "Dest"} <= have:
        add["route"] = route_key(F.col("Origin"), F.col("Dest"), missing="UNK")
    if "sched_dep_utc" not in have:
        seen = "origin_weather_timestamp_utc"
        add["sched_dep_utc"] = F.col(seen).cast("timestamp") if seen in have else F.lit(None).cast("timestamp")
    if "scheduled_arrival_hour_local" not in have and "scheduled_departure_hour_local" in have:
        add["scheduled_arrival_hour_local"] = F.col("scheduled_departure_hour_local")
    for c in OPTIONAL_NUMERIC:
        if c not in have:
            add[c] = F.lit(None).cast("double")
    day = F.col("FlightDate").cast("date")
    for name, from_date in (("month", F.month(day)), ("day_of_week", weekday_number(day))):
        given = F.col(name) if name in have else F.lit(None)
        add[name] = F.coalesce(given.cast("double"), from_date.cast("double"))
    return df.withColumns(add)

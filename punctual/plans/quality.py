"""Data-quality figures and dataset summaries as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.contracts import FLIGHT_DUPLICATE_KEY
from punctual.functions.clock import hhmm_to_minutes
from punctual.operators.aggregate import (
    count_mean_median, duplicate_count, group_mean_flags, missing_rates, present, skewness_table, value_counts,
)
from punctual.operators.project import top_entities


def tidy(row: DataFrame) -> DataFrame:
    """A one-row frame of figures as (metric, value)."""
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "metric", "value")


def quality_figures(
    flights: DataFrame,
    weather: DataFrame,
    duplicate_key: Sequence[str],
    clock_columns: Sequence[str],
    missing: Sequence[str],
    flags: Sequence[str] = (),
    joined: dict[str, str] | None = None,
) -> DataFrame:
    """(metric, value): row counts, duplicates, malformed clock texts, shares.

    All figures of one table come from one pass over it.
    """
    figures: list[Column] = [F.count(F.lit(1)).alias("flights_rows")]
    figures += [F.count_if(hhmm_to_minutes(F.col(c)).isNull()).alias(f"malformed_{c}") for c in clock_columns]
    figures += [F.avg(F.col(c).isNull().cast("int")).alias(f"missing_share_{c}") for c in missing]
    figures += [F.avg(c).alias(f"positive_share_{c}") for c in flags]
    figures += [present(F.col(c)).alias(n) for n, c in (joined or {}).items()]
    return (
        tidy(flights.agg(*figures))
        .unionByName(tidy(weather.agg(F.count(F.lit(1)).alias("weather_rows"))))
        .unionByName(tidy(duplicate_count(flights, duplicate_key).withColumnRenamed("duplicates", "duplicate_flights")))
    )


def quality_report(
    flights: DataFrame, mapping: DataFrame, weather: DataFrame, modeling: DataFrame
) -> dict[str, DataFrame]:
    """The parts of the data-quality report of a dataset build."""
    missing = [c for c in ("DepDelay", "ArrDelay", "CarrierDelay", "WeatherDelay") if c in flights.columns]
    clocks = [c for c in ("CRSDepTime", "CRSArrTime") if c in flights.columns]
    key = [c for c in FLIGHT_DUPLICATE_KEY if c in flights.columns]
    figures = quality_figures(flights, weather, key, clocks, missing)
    modelled = modeling.agg(
        F.count(F.lit(1)).alias("modeling_rows"),
        present(F.col("origin_temp_c")).alias("origin_weather_join_rate"),
        present(F.col("dest_temp_c")).alias("dest_weather_join_rate"),
        F.avg("dep_delayed_15").alias("dep_positive_share"),
        F.avg("arr_delayed_15").alias("arr_positive_share"),
    )
    unmapped = mapping.agg(F.count_if(F.col("station_id").isNull()).alias("missing_station_mappings"))
    return {
        "overview": figures.unionByName(tidy(modelled)).unionByName(tidy(unmapped)),
        "carriers": group_mean_flags(modeling, "Reporting_Airline", ["dep_delayed_15", "arr_delayed_15"]).orderBy("Reporting_Airline"),
        "origins": count_mean_median(modeling, "Origin", "dep_delay_minutes").orderBy("Origin"),
        "mapping_confidence": value_counts(mapping, "mapping_confidence"),
    }


def dataset_summary(
    df: DataFrame,
    name: str,
    origin: str = "Origin",
    dest: str = "Dest",
    day: str = "FlightDate",
    flag: str = "dep_delayed_15",
    hour: str = "scheduled_departure_hour_local",
    rain: str = "origin_precip_mm",
    present: Sequence[str] = (
        "origin_temp_c", "origin_visibility_m", "origin_wind_speed_mps", "origin_precip_mm", "origin_ceiling_m",
    ),
    missing: Sequence[str] = ("origin_temp_c", "origin_visibility_m", "origin_precip_mm"),
) -> DataFrame:
    """One row: size, span, rates overall and under conditions, shares present, busiest origins."""
    has = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    when = lambda cond: F.avg(F.when(cond, F.col(flag)))
    busiest = top_entities(df, origin, 10)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("r"), F.col(origin).alias("o"))))
    names = busiest.agg(F.array_join(F.transform(ranked, lambda s: s["o"]), ", ").alias("names"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(origin).alias("unique_origins"),
        F.count_distinct(dest).alias("unique_destinations"),
        F.min(day).alias("date_start"),
        F.max(day).alias("date_end"),
        F.avg(flag).alias("delay_rate"),
        *[has(c).alias(f"present_{c}") for c in present],
        *[(1 - has(c)).alias(f"missing_{c}") for c in missing],
        when(F.col(hour).between(6, 11)).alias("morning_delay_rate"),
        when(F.col(hour).between(17, 22)).alias("evening_delay_rate"),
        when(F.coalesce(F.col(rain), F.lit(0)) > 0).alias("bad_weather_delay_rate"),
    ).select(F.lit(name).alias("dataset"), "*", names.scalar().alias("top_10_origins"))


def feature_type_counts(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """How many features of each kind; the schema alone answers this."""
    have = set(df.columns)
    c, n = len([x for x in categorical if x in have]), len([x for x in numeric if x in have])
    rows = [("categorical", c), ("numeric", n), ("total_model_features", c + n)]
    return df.sparkSession.createDataFrame(rows, "feature_type string, count bigint")


def preprocessing_summary(train: DataFrame, test: DataFrame, features: Sequence[str], numeric: Sequence[str]) -> dict[str, DataFrame]:
    """Row counts, highest missing shares and most skewed columns of the training frame."""
    rows = train.agg(F.count(F.lit(1)).alias("train_rows")).withColumn(
        "test_rows", test.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    return {
        "rows": tidy(rows),
        "missing": missing_rates(train, features, top=15),
        "skewness": skewness_table(train, numeric, top=15),
    }

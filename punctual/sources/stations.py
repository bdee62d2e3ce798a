"""Station history list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.contracts import STATION_RENAMES
from punctual.functions.values import to_number
from punctual.operators.project import require_columns


def zero_fill(c: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def clean_stations(raw: DataFrame) -> DataFrame:
    """Station list with clean headers, typed position and dates, and an 11-character id."""
    tidy = {c: c.strip().replace(" ", "_").replace("(", "").replace(")", "") for c in raw.columns}
    df = raw.withColumnsRenamed(tidy).withColumnsRenamed(STATION_RENAMES)
    df = require_columns(df, [(n, "string") for n in STATION_RENAMES.values()])
    code = lambda c: F.upper(F.trim(F.col(c)))
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({
        "latitude": to_number(F.col("latitude")),
        "longitude": to_number(F.col("longitude")),
        "begin_date": day("begin_date"),
        "end_date": day("end_date"),
        "station_id": F.concat(zero_fill(text("usaf"), 6), zero_fill(text("wban"), 5)),
        "icao": code("icao"), "call": code("call"), "state": code("state"), "country": code("country"),
        "station_name": F.trim("station_name"),
    })
    return df.where(F.length("station_id") == 11)


def read_station_history(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The station list from CSV, every field read as text."""
    return clean_stations(spark.read.option("header", True).csv(path))

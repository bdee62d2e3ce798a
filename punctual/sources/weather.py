"""Station reports: JSON reader and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.contracts import (
    CODE_FIELDS, PRECIP_FIELDS, WEATHER_COLUMNS, WEATHER_MEASURES, WEATHER_RAW_COLUMNS, struct_of,
)
from punctual.functions.values import (
    compound_numeric, compound_text, first_present, relative_humidity, to_number,
)
from punctual.operators.aggregate import dedupe_keep_first
from punctual.operators.project import project_contract


def read_weather_json(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Station-year JSON arrays as text columns.

    Text keeps leading zeros of station ids; fields a file lacks are null; an empty file
    gives no rows.  A file with one array is read as a whole; it holds one station and year,
    so it is a bounded unit.  Files with one record or array per line (``multi_line=False``)
    are split like any text.
    """
    schema = struct_of([(c, "string") for c in WEATHER_RAW_COLUMNS])
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def clean_weather(raw: DataFrame, reference_compat: bool = False) -> DataFrame:
    """Raw reports in the 18-column contract, one row per station and time (the first one).

    ``reference_compat`` keeps two quirks: signed missing markers count as measurements, and
    an absent weather code is an empty text that hides later codes.
    """
    have = set(raw.columns)
    compat = {"reference_compat": reference_compat}
    measures = {
        name: compound_numeric(F.col(field), part, scale, markers, **compat).alias(name)
        if field in have
        else F.lit(None).cast("double").alias(name)
        for name, (field, part, scale, markers) in WEATHER_MEASURES.items()
    }
    precip = first_present([compound_numeric(F.col(c), 1, 10.0, **compat) for c in PRECIP_FIELDS if c in have])
    codes = first_present([compound_text(F.col(c), 0, **compat) for c in CODE_FIELDS if c in have], "string")
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    number = lambda c: to_number(F.col(c)) if c in have else F.lit(None).cast("double")
    parsed = raw.select(
        text("STATION").alias("station_id"),
        F.col("DATE").try_cast("timestamp").alias("timestamp_utc"),
        text("NAME").alias("station_name"),
        number("LATITUDE").alias("station_latitude"),
        number("LONGITUDE").alias("station_longitude"),
        text("REPORT_TYPE").alias("report_type"),
        text("SOURCE").alias("source"),
        text("CALL_SIGN").alias("call_sign"),
        *measures.values(),
        precip.alias("precip_mm"),
        codes.alias("weather_code"),
    ).where(F.col("timestamp_utc").isNotNull())
    parsed = parsed.withColumn(
        "relative_humidity_pct", relative_humidity(F.col("temperature_c"), F.col("dew_point_c"))
    )
    contract = project_contract(parsed, WEATHER_COLUMNS)
    rest = [c for c, _ in WEATHER_COLUMNS if c not in ("station_id", "timestamp_utc")]
    return dedupe_keep_first(contract, ["station_id", "timestamp_utc"], order=rest)

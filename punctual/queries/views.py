"""Views over the given tables that look like trips, observations and legs.

Every view exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; wall-clock timestamps count as UTC instants."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = lambda c: F.concat(F.lit("A"), F.lpad(c.cast("string"), 2, "0"))
    df = e.select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").alias("dep_ts"),
        F.to_date("ts").alias("trip_date"),
        code(F.col("user_id") % 30).alias("origin"),
        code((F.col("user_id") * 7 + F.col("event_id")) % 30).alias("dest"),
        F.col("event_type").alias("carrier"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("tail"),
        F.get_json_object("props", "$.k").cast("int").alias("distance"),
        F.when(F.col("event_id") % 50 != 0, F.col("value").cast("decimal(18,2)") - F.lit(30)).cast("double").alias("dep_delay"),
        F.lpad(((F.col("event_id") * 37) % 2500).cast("string"), 4, "0").alias("dep_hhmm"),
    )
    return df.withColumns({
        "route": F.concat_ws("_", "origin", "dest"),
        "delayed": F.coalesce((F.col("dep_delay") >= 15).cast("int"), F.lit(0)),
    })


TRIPS = """
trips AS (
  SELECT *, origin || '_' || dest AS route,
         CASE WHEN dep_delay >= 15 THEN 1 ELSE 0 END AS delayed
  FROM (
    SELECT event_id AS trip_id, ts AS dep_ts, CAST(ts AS DATE) AS trip_date,
           'A' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') AS origin,
           'A' || lpad(CAST((user_id * 7 + event_id) % 30 AS VARCHAR), 2, '0') AS dest,
           event_type AS carrier,
           CASE WHEN user_id % 11 <> 0 THEN 'T' || CAST(user_id AS VARCHAR) END AS tail,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS distance,
           CAST(CASE WHEN event_id % 50 <> 0 THEN CAST(value AS DECIMAL(18,2)) - 30 END AS DOUBLE) AS dep_delay,
           lpad(CAST((event_id * 37) % 2500 AS VARCHAR), 4, '0') AS dep_hhmm
    FROM events
  )
)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    padded = F.lpad(F.floor("value").cast("string"), 4, "0")
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.concat(F.lit("A"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0")).alias("station"),
        F.col("ts").alias("obs_ts"),
        F.col("value").alias("reading"),
        F.when(F.col("event_id") % 9 == 0, F.lit(None))
        .when(F.col("event_id") % 7 == 0, "+9999,9")
        .otherwise(F.concat(F.lit("+"), padded, F.lit(",1")))
        .alias("tmp_raw"),
    )


OBS = """
obs AS (
  SELECT event_id AS obs_id, 'A' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') AS station, ts AS obs_ts,
         value AS reading,
         CASE WHEN event_id % 9 = 0 THEN NULL
              WHEN event_id % 7 = 0 THEN '+9999,9'
              ELSE '+' || lpad(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 4, '0') || ',1' END AS tmp_raw
  FROM events WHERE event_type = 'view'
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n"

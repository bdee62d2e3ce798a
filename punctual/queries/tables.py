"""Sources, projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import aggregate, join, project, split
from punctual.queries.registry import query
from punctual.queries.views import OBS, TRIPS, obs, table, trips, with_views
from punctual.session import shared_folder
from punctual.sources import flights, stations, tables, weather


# --- sources ---------------------------------------------------------------------------
@query("flight_files", """
SELECT 'on_time_' || strftime(o_orderdate, '%Y_') || CAST(month(o_orderdate) AS VARCHAR) AS source, year(o_orderdate) AS data_year,
       month(o_orderdate) AS data_month, o_orderpriority AS carrier, count(*) AS flights,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS distance, count(CASE WHEN o_custkey % 9 <> 0 THEN 1 END) AS with_delay
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate BETWEEN TIMESTAMP '1996-01-15' AND TIMESTAMP '1999-06-30'
GROUP BY ALL""")
def flight_files(spark, sf_dir):
    """Orders written as monthly CSV files with untidy headers and codes, then read as trips."""
    orders = table(spark, sf_dir, "orders")
    raw = orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("FlightDate"),
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("Reporting_Airline"),
        F.col("o_orderkey").alias("Flight_Number_Reporting_Airline "),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey").cast("string")).otherwise("n/a").alias("DepDelay"),
        F.col("o_totalprice").alias("Distance"),
        F.concat(F.lit("on_time_"), F.date_format("o_orderdate", "yyyy_M")).alias("month_file"),
    )
    path = shared_folder(spark)
    raw.repartition("month_file").write.partitionBy("month_file").option("header", True).csv(path)
    df = flights.read_flights(
        spark, f"{path}/*/", airlines=["1-urgent ", "5-LOW"], start="1996-01-15", end="1999-06-30"
    )
    month = F.date_format("FlightDate", "yyyy_M")
    return (
        df.withColumn("source", F.concat(F.lit("on_time_"), month))
        .groupBy(
            "source", F.year("FlightDate").cast("bigint").alias("data_year"),
            F.month("FlightDate").cast("bigint").alias("data_month"), F.col("Reporting_Airline").alias("carrier"),
        )
        .agg(
            F.count(F.lit(1)).alias("flights"),
            F.round(aggregate.exact_mean(F.col("Distance")) * F.count("Distance"), 2).alias("distance"),
            F.count("DepDelay").alias("with_delay"),
        )
    )


_REPORT_SQL = with_views(OBS) + """
, p AS (SELECT *, '0' || station AS station_id, trim(split_part(tmp_raw, ',', 1)) AS t FROM obs)
SELECT station_id, count(*) AS rows,
       round(avg(CASE WHEN t IN ('+9999', '+0999') THEN NULL ELSE TRY_CAST(t AS DOUBLE) / 10 END), 6) AS mean_temp,
       count(CASE WHEN obs_id % 4 = 0 THEN 1 END) AS coded, count(*) AS without_wind
FROM p GROUP BY 1"""


def _raw_reports(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.select(
        F.concat(F.lit("0"), "station").alias("STATION"),
        F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DATE"),
        F.when(F.col("tmp_raw") == "+0999,1", F.lit("+9999,9")).otherwise(F.col("tmp_raw")).alias("TMP"),
        F.when(F.col("obs_id") % 4 == 0, F.lit("61,1")).alias("AW1"),
        F.col("station").alias("folder"),
    )


def _report_summary(clean):
    return clean.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("temperature_c"), 6).alias("mean_temp"),
        F.count("weather_code").alias("coded"),
        F.sum(F.col("wind_speed_mps").isNull().cast("bigint")).alias("without_wind"),
    )


@query("weather_json_files", _REPORT_SQL)
def weather_json_files(spark, sf_dir):
    """Observations written as JSON files per station, one record a line, then read and cleaned."""
    raw = _raw_reports(spark, sf_dir)
    path = shared_folder(spark)
    # each line is a JSON array of one record
    raw.select(F.concat(F.lit("["), F.to_json(F.struct(*[c for c in raw.columns if c != "folder"])), F.lit("]")).alias("value"), "folder").write.partitionBy("folder").text(path)
    return _report_summary(weather.clean_weather(weather.read_weather_json(spark, f"{path}/*/", multi_line=False)))


@query("weather_array_files", _REPORT_SQL)
def weather_array_files(spark, sf_dir):
    """The same written as one JSON array per station and year, as such files come, each read as a whole."""
    raw = _raw_reports(spark, sf_dir)
    path = shared_folder(spark)
    record = F.struct(*[c for c in raw.columns if c != "folder"])
    years = raw.groupBy("folder", F.substring("DATE", 1, 4).alias("year")).agg(F.to_json(F.collect_list(record)).alias("value"))
    years.repartition("folder", "year").write.partitionBy("folder", "year").text(path)
    return _report_summary(weather.clean_weather(weather.read_weather_json(spark, f"{path}/*/*/")))


@query("clean_obs", """
WITH r AS (
  SELECT 'S' || CAST(l_suppkey % 40 AS VARCHAR) AS station_id, l_shipdate AS t, l_orderkey, l_linenumber,
         CASE WHEN l_quantity = 50 THEN '+9999,9' WHEN l_quantity = 49 THEN NULL ELSE '+' || lpad(CAST(CAST(l_quantity * 5 AS BIGINT) AS VARCHAR), 4, '0') || ',1' END AS tmp,
         '-' || lpad(CAST(CAST(l_linenumber * 7 AS BIGINT) AS VARCHAR), 4, '0') || ',1' AS dew
  FROM lineitem
), v AS (
  SELECT station_id, t, CASE WHEN tmp IS NULL OR tmp = '+9999,9' THEN NULL ELSE CAST(split_part(tmp, ',', 1) AS DOUBLE) / 10 END AS temp,
         CAST(split_part(dew, ',', 1) AS DOUBLE) / 10 AS dew FROM r
), f AS (
  SELECT station_id, t, temp, dew FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, t ORDER BY temp NULLS FIRST, dew) AS rn FROM v) WHERE rn = 1
)
SELECT station_id, count(*) AS rows, count(temp) AS temps, round(avg(temp), 6) AS mean_temp, round(avg(dew), 6) AS mean_dew,
       round(avg(CASE WHEN temp IS NOT NULL THEN 100 * exp(17.625 * dew / (243.04 + dew)) / exp(17.625 * temp / (243.04 + temp)) END), 5) AS mean_humidity
FROM f GROUP BY 1""")
def clean_obs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    digits = lambda c: F.lpad(c.cast("bigint").cast("string"), 4, "0")
    raw = li.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string")).alias("STATION"),
        F.col("l_shipdate").cast("string").alias("DATE"),
        F.when(F.col("l_quantity") == 50, "+9999,9").when(F.col("l_quantity") == 49, F.lit(None))
        .otherwise(F.concat(F.lit("+"), digits(F.col("l_quantity") * 5), F.lit(",1"))).alias("TMP"),
        F.concat(F.lit("-"), digits(F.col("l_linenumber") * 7), F.lit(",1")).alias("DEW"),
    )
    return weather.clean_weather(raw).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("temperature_c").alias("temps"),
        F.round(F.avg("temperature_c"), 6).alias("mean_temp"), F.round(F.avg("dew_point_c"), 6).alias("mean_dew"),
        F.round(F.avg("relative_humidity_pct"), 5).alias("mean_humidity"),
    )


# customers as a station list
def station_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    letters = F.concat(*[F.char(F.lit(65) + (F.floor(key / d) % 26)) for d in (1, 26)])
    return c.select(
        F.when(key % 97 == 0, F.lit("7654321")).otherwise(key.cast("string")).alias("USAF"),
        F.when(key % 5 != 0, (key % 100000).cast("string")).alias("WBAN"),
        F.concat(F.lit(" "), letters, F.when(key % 3 == 0, " INTL AIRPORT").otherwise(" MUNI"),
                 F.when(key % 17 == 0, F.concat(F.lit(" #"), (key % 50).cast("string"))).otherwise(""), F.lit(" ")).alias("STATION NAME"),
        F.when(key % 7 == 0, "CA").otherwise("us ").alias("CTRY"),
        F.concat(F.lit("S"), (F.col("c_nationkey") % 5).cast("string")).alias("STATE"),
        F.when(key % 2 == 0, F.concat(F.lit("K"), F.lit("Q"), F.lower(letters))).alias("ICAO"),
        F.when(key % 11 == 0, F.concat(F.lit("Q"), letters)).alias("CALL"),
        F.col("c_acctbal").cast("string").alias("LAT"),
        F.when(key % 13 == 0, "x").otherwise(F.lit("-70.5")).alias("LON"),
        F.lit("12").alias("ELEV(M)"),
        F.when(key % 4 != 0, F.concat((F.lit(1990) + key % 12).cast("string"), F.lit("0131"))).alias("BEGIN"),
        F.when(key % 6 != 0, F.concat((F.lit(1993) + key % 15).cast("string"), F.lit("1231"))).alias("END"),
    )


STATIONS = """
letters AS (
  SELECT *, c_custkey AS k, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + (c_custkey // 26) % 26 AS INTEGER)) AS l FROM customer
), station_rows AS (
  SELECT k, (CASE WHEN k % 97 = 0 THEN '7654321' WHEN length(CAST(k AS VARCHAR)) < 6 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END)
           || (CASE WHEN k % 5 <> 0 THEN lpad(CAST(k % 100000 AS VARCHAR), 5, '0') ELSE '00000' END) AS station_id,
         l || CASE WHEN k % 3 = 0 THEN ' INTL AIRPORT' ELSE ' MUNI' END || CASE WHEN k % 17 = 0 THEN ' #' || CAST(k % 50 AS VARCHAR) ELSE '' END AS station_name,
         CASE WHEN k % 7 = 0 THEN 'CA' ELSE 'US' END AS country, 'S' || CAST(c_nationkey % 5 AS VARCHAR) AS state,
         CASE WHEN k % 2 = 0 THEN 'KQ' || l END AS icao, CASE WHEN k % 11 = 0 THEN 'Q' || l END AS call,
         c_acctbal AS latitude, CASE WHEN k % 13 <> 0 THEN -70.5 END AS longitude,
         CASE WHEN k % 4 <> 0 THEN 1990 + k % 12 END AS begin_year, CASE WHEN k % 6 <> 0 THEN 1993 + k % 15 END AS end_year
  FROM letters
), stations AS (SELECT * FROM station_rows WHERE length(station_id) = 11)"""


@query("station_history", with_views(STATIONS) + """
SELECT station_id, station_name, country, state, icao, call, round(latitude, 2) AS latitude, longitude,
       begin_year || '-01-31' AS begin_date, end_year || '-12-31' AS end_date FROM stations""")
def station_history(spark, sf_dir):
    df = stations.clean_stations(station_list(spark, sf_dir))
    return df.select(
        "station_id", "station_name", "country", "state", "icao", "call", F.round("latitude", 2).alias("latitude"), "longitude",
        F.date_format("begin_date", "yyyy-MM-dd").alias("begin_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"),
    )


@query("station_history_files", with_views(STATIONS) + """
SELECT country, state, count(*) AS stations, count(icao) AS with_icao, count(longitude) AS located FROM stations GROUP BY 1, 2""")
def station_history_files(spark, sf_dir):
    path = shared_folder(spark)
    station_list(spark, sf_dir).write.option("header", True).csv(path)
    df = stations.read_station_history(spark, path)
    return df.groupBy("country", "state").agg(
        F.count(F.lit(1)).alias("stations"), F.count("icao").alias("with_icao"), F.count("longitude").alias("located")
    )


@query("read_pruned", "SELECT l_shipmode_missing, l_returnflag, count(*) AS rows FROM (SELECT 0 AS l_shipmode_missing, l_returnflag FROM lineitem) GROUP BY 1, 2")
def read_pruned(spark, sf_dir):
    df = tables.read_table_pruned(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_shipmode"])
    missing = F.lit(int("l_shipmode" in df.columns)).alias("l_shipmode_missing")
    return df.groupBy(missing, "l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


@query("partitioned_table", """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS orders FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2""")
def partitioned_table(spark, sf_dir):
    """Written by year and month, read back with partition pruning."""
    path = shared_folder(spark)
    orders = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    tables.write_table(orders, path, ["year", "month"], ["o_orderdate", "o_orderkey"])
    back = spark.read.parquet(path).where("year >= 1998")
    return back.groupBy(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query("metric_table", "SELECT o_orderpriority AS model, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def metric_table(spark, sf_dir):
    path = shared_folder(spark)
    metrics = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score")
    )
    tables.write_metrics(metrics, path)
    return tables.read_metrics(spark, path, "model string, n bigint, score double")


@query("cached_month", """
SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def cached_month(spark, sf_dir):
    """A part stored once without filters; two readers with different filters are both right."""
    path = shared_folder(spark)
    build = lambda: table(spark, sf_dir, "orders")
    tables.cached_partition(spark, path, build, F.col("o_orderstatus") == "F")
    kept = tables.cached_partition(spark, path, build, F.col("o_orderstatus") != "P")
    return kept.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"))


# --- projections and filters --------------------------------------------------------------
@query("normalize_columns", """
SELECT upper(trim(' ' || p_brand || ' ')) AS carrier, CAST(NULL AS VARCHAR) AS region, p_partkey, '2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS text_date,
       CASE WHEN p_size <= 31 THEN '2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS day FROM part""")
def normalize_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    date = F.concat(F.lit("2024-01-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    raw = p.select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("carrier "), "p_partkey", date.alias("day"), date.alias("text_date"))
    df = project.normalize_columns(
        raw, [("day", "string"), ("carrier", "string"), ("region", "string")], {"carrier ": "carrier"}, ["carrier", "region"], "day"
    )
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("filter_in_range", """
SELECT l_returnflag, l_linestatus, count(*) AS rows, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-02-01' AND l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def filter_in_range(spark, sf_dir):
    li = project.filter_in(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "R"])
    li = project.filter_date_range(li, "l_shipdate", "1996-02-01", "1998-09-02")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"),
    )


@query("filter_in_long_list", """
SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1""")
def filter_in_long_list(spark, sf_dir):
    """The wanted keys are themselves a table: a semi join."""
    customers = table(spark, sf_dir, "customer")
    orders = project.filter_in(table(spark, sf_dir, "orders"), "o_custkey", customers.where("c_acctbal < 0").select("c_custkey"))
    joined = join.attach_dimension(orders, customers, "o_custkey", "c_custkey", {"c_mktsegment": "c_mktsegment"})
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


@query("require_not_null", with_views(TRIPS) + """
SELECT carrier, count(*) AS rows FROM trips WHERE tail IS NOT NULL AND dep_delay IS NOT NULL GROUP BY 1""")
def require_not_null(spark, sf_dir):
    return project.require_not_null(trips(spark, sf_dir), ["tail", "dep_delay"]).groupBy("carrier").agg(F.count(F.lit(1)).alias("rows"))


@query("keep_top_entities", with_views(TRIPS) + """
, top AS (SELECT origin FROM (SELECT origin, count(*) AS n FROM trips GROUP BY 1) ORDER BY n DESC, origin LIMIT 10)
SELECT origin, count(*) AS rows, round(avg(delayed), 6) AS rate FROM trips WHERE origin IN (SELECT origin FROM top) GROUP BY 1""")
def keep_top_entities(spark, sf_dir):
    df = project.keep_top_entities(trips(spark, sf_dir), "origin", 10)
    return df.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("delayed"), 6).alias("rate"))


@query("weather_coverage", with_views(TRIPS, OBS) + """
, typed AS (SELECT * FROM obs WHERE obs_id % 3 = 0)
SELECT l.origin, count(*) AS covered FROM trips l ASOF JOIN typed o ON l.origin = o.station AND l.dep_ts >= o.obs_ts
WHERE l.carrier <> 'view' AND o.obs_ts >= l.dep_ts - INTERVAL 3 HOUR GROUP BY 1""")
def weather_coverage(spark, sf_dir):
    kind = F.when(F.col("obs_id") % 3 == 0, "FM-15").otherwise("FM-16")
    routine = obs(spark, sf_dir).withColumn("report_type", kind).where("report_type = 'FM-15'")
    left = trips(spark, sf_dir).where("carrier <> 'view'")
    payload = {"origin_weather_timestamp_utc": "obs_ts"}
    df = join.asof_join(left, routine, "origin", "station", "dep_ts", "obs_ts", payload, "3 HOURS")
    return project.require_weather_coverage(df).groupBy("origin").agg(F.count(F.lit(1)).alias("covered"))


@query("live_features", with_views(TRIPS) + """
SELECT 'dep_delay' AS feature, count(dep_delay) AS present FROM trips UNION ALL SELECT 'distance', count(distance) FROM trips""")
def live_features(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({"void": F.lit(None).cast("double"), "nothing": F.lit(float("nan"))})
    live = project.non_null_features(t, ["dep_delay", "void", "distance", "nothing"])
    return t.agg(*[F.count(c).alias(c) for c in live]).unpivot([], live, "feature", "present")


@query("project_contract", "SELECT s_suppkey AS id, CAST(NULL AS DOUBLE) AS absent, CAST(s_acctbal AS VARCHAR) IS NOT NULL AS known FROM supplier")
def project_contract(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").isNotNull().alias("known"), "s_name")
    return project.project_contract(s, [("id", "bigint"), ("absent", "double"), ("known", "boolean")])


@query("fallback_columns", with_views(TRIPS) + """
SELECT route, scheduled_hour AS arrival_hour, month, day_of_week, count(*) AS rows, 0 AS with_dest_temp
FROM (SELECT origin || '_' || dest AS route, CAST(hour(dep_ts) AS DOUBLE) AS scheduled_hour, CAST(month(trip_date) AS DOUBLE) AS month,
             CAST(CASE WHEN trip_id % 2 = 0 THEN 9 ELSE isodow(trip_date) END AS DOUBLE) AS day_of_week FROM trips) GROUP BY ALL""")
def fallback_columns(spark, sf_dir):
    t = trips(spark, sf_dir).select(
        F.col("origin").alias("Origin"), F.col("dest").alias("Dest"), F.col("trip_date").alias("FlightDate"),
        F.hour("dep_ts").cast("double").alias("scheduled_departure_hour_local"),
        F.when(F.col("trip_id") % 2 == 0, F.lit(9.0)).alias("day_of_week"),
    )
    df = project.fallback_columns(t)
    return df.groupBy("route", F.col("scheduled_arrival_hour_local").alias("arrival_hour"), "month", "day_of_week").agg(
        F.count(F.lit(1)).alias("rows"), F.count("dest_temp_c").cast("int").alias("with_dest_temp")
    )


# --- joins and sets ------------------------------------------------------------------------
@query("attach_dimension", """
SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS pairs
FROM customer LEFT JOIN supplier ON c_custkey % 100 = s_suppkey
LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2""")
def attach_dimension(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    df = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey") % 100)
    df = join.attach_dimension(df, table(spark, sf_dir, "supplier"), "key", "s_suppkey", {"s_nationkey": "s_nationkey"})
    df = join.attach_dimension(df, nation, "c_nationkey", "n_nationkey", {"n_name": "customer_nation"})
    df = join.attach_dimension(df, nation, "s_nationkey", "n_nationkey", {"n_name": "supplier_nation"})
    return df.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("pairs"))


@query("repeated_dimension_keys", "SELECT s_nationkey, count(*) AS rows FROM supplier GROUP BY 1 HAVING count(*) > 1")
def repeated_dimension_keys(spark, sf_dir):
    return join.repeated_keys(table(spark, sf_dir, "supplier"), "s_nationkey")


@query("geo_top_entities", """
WITH s AS (SELECT o_custkey, count(*) AS flights, avg(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END) AS rate FROM orders GROUP BY 1)
SELECT o_custkey, flights, round(rate, 6) AS delay_rate, latitude, longitude FROM s
JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS latitude, CAST(c_nationkey AS DOUBLE) AS longitude FROM customer) ON o_custkey = c_custkey
WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY flights DESC, o_custkey LIMIT 75""")
def geo_top_entities(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("late", (F.col("o_totalprice") >= 250000).cast("int"))
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("latitude"),
        F.col("c_nationkey").cast("double").alias("longitude"),
    )
    return join.attach_geo_topn(orders, places, "o_custkey", "late").withColumn("delay_rate", F.round("delay_rate", 6))


_PRIORITY = "SELECT o_orderpriority AS model, round(avg(o_totalprice) / 1000000, 6) AS f1, round(min(o_totalprice) / 1000, 6) AS precision, round(max(o_totalprice) / 1000000, 6) AS recall, CAST(count(*) AS DOUBLE) / 10000 AS accuracy FROM orders"


def _priority_metrics(df):
    return df.groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg("o_totalprice") / 1000000, 6).alias("f1"), F.round(F.min("o_totalprice") / 1000, 6).alias("precision"),
        F.round(F.max("o_totalprice") / 1000000, 6).alias("recall"), (F.count(F.lit(1)).cast("double") / 10000).alias("accuracy"),
    )


@query("upsert_metrics", f"""
WITH a AS ({_PRIORITY} GROUP BY 1), b AS ({_PRIORITY} WHERE o_orderstatus = 'F' AND o_orderpriority < '3' GROUP BY 1)
SELECT * FROM a WHERE model NOT IN (SELECT model FROM b) UNION ALL SELECT * FROM b""")
def upsert_metrics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    newer = orders.where("o_orderstatus = 'F' AND o_orderpriority < '3'")
    return join.upsert_metrics(_priority_metrics(orders), _priority_metrics(newer))


@query("compare_families", f"""
WITH a AS ({_PRIORITY} GROUP BY 1), b AS ({_PRIORITY} WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT model, precision, recall, f1, 'tabular' AS family FROM a
UNION ALL SELECT * FROM (SELECT 'text_' || model, precision, recall, f1, 'text' FROM b ORDER BY f1 DESC, accuracy DESC, model LIMIT 1)""")
def compare_families(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ours = _priority_metrics(orders).drop("accuracy")
    theirs = _priority_metrics(orders.where("o_orderstatus = 'F'"))
    return join.compare_families(ours, theirs, "text", "text_")


@query("union_months", """
SELECT part, count(*) AS rows, count(note) AS notes FROM (
  SELECT 'orders' AS part, o_orderstatus AS note FROM orders UNION ALL SELECT 'lines', NULL FROM lineitem) GROUP BY 1""")
def union_months(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("orders").alias("part"), F.col("o_orderstatus").alias("note"))
    b = table(spark, sf_dir, "lineitem").select(F.lit("lines").alias("part"))
    return join.union_all([a, b]).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count("note").alias("notes"))


@query("first_seen_values", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_seen_values(spark, sf_dir):
    return aggregate.ordered_unique(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("sorted_report", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1 ORDER BY orders DESC, o_orderpriority")
def sorted_report(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return split.sort_by(counts, F.desc("orders"), "o_orderpriority")

"""Column functions on whole tables."""

from __future__ import annotations

import pandas as pd
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from punctual.functions import clock, values
from punctual.queries.registry import query
from punctual.queries.views import OBS, TRIPS, obs, table, trips, with_views

_HHMM = """CASE WHEN {c} IS NULL OR trim({c}) = '' OR NOT regexp_full_match({p}, '[0-9]+') THEN NULL
      WHEN substr({p}, 1, 2) = '24' AND CAST(substr({p}, 3) AS HUGEINT) = 0 THEN 0
      WHEN CAST(substr({p}, 1, 2) AS INTEGER) <= 23 AND CAST(substr({p}, 3) AS HUGEINT) <= 59
      THEN CAST(substr({p}, 1, 2) AS INTEGER) * 60 + CAST(substr({p}, 3) AS INTEGER) END"""


def hhmm_sql(c: str) -> str:
    whole = f"split_part(trim({c}), '.', 1)"
    padded = f"CASE WHEN length({whole}) < 4 THEN lpad({whole}, 4, '0') ELSE {whole} END"
    return _HHMM.format(c=c, p=f"({padded})")


# the clock text of a trip in the shapes such files use: padded, bare, with decimals, blanks, junk
_SHAPED = """CASE trip_id % 7 WHEN 0 THEN dep_hhmm WHEN 1 THEN CAST(CAST(dep_hhmm AS INTEGER) AS VARCHAR)
    WHEN 2 THEN dep_hhmm || '.0' WHEN 3 THEN ' ' || dep_hhmm || ' ' WHEN 4 THEN '12' || dep_hhmm
    WHEN 5 THEN CASE WHEN trip_id % 2 = 0 THEN '' ELSE 'x' || dep_hhmm END END"""


@query("hhmm_minutes", with_views(TRIPS) + f""", s AS (SELECT *, {_SHAPED} AS shaped FROM trips)
SELECT trip_id, CAST({hhmm_sql("dep_hhmm")} AS DOUBLE) AS minutes, CAST({hhmm_sql("shaped")} AS DOUBLE) AS shaped_minutes,
       CAST(({hhmm_sql("dep_hhmm")}) // 60 AS DOUBLE) AS hour
FROM s""")
def hhmm_minutes(spark, sf_dir):
    bare = F.col("dep_hhmm").cast("int").cast("string")
    k = F.col("trip_id") % 7
    shaped = (
        F.when(k == 0, F.col("dep_hhmm")).when(k == 1, bare).when(k == 2, F.concat("dep_hhmm", F.lit(".0")))
        .when(k == 3, F.concat(F.lit(" "), "dep_hhmm", F.lit(" "))).when(k == 4, F.concat(F.lit("12"), "dep_hhmm"))
        .when(k == 5, F.when(F.col("trip_id") % 2 == 0, "").otherwise(F.concat(F.lit("x"), "dep_hhmm")))
    )
    minutes = clock.hhmm_to_minutes(F.col("dep_hhmm"))
    return trips(spark, sf_dir).select(
        "trip_id", minutes.cast("double").alias("minutes"),
        clock.hhmm_to_minutes(shaped).cast("double").alias("shaped_minutes"),
        clock.hour_of_minutes(minutes).cast("double").alias("hour"),
    )


@query("local_schedule_times", with_views(TRIPS) + f""", m AS (SELECT trip_id, trip_date, {hhmm_sql("dep_hhmm")} AS minutes FROM trips)
SELECT trip_id, strftime(CAST(trip_date AS TIMESTAMP) + to_minutes(minutes), '%Y-%m-%d %H:%M:%S') AS local_time FROM m""")
def local_schedule_times(spark, sf_dir):
    local = clock.date_plus_minutes(F.col("trip_date"), clock.hhmm_to_minutes(F.col("dep_hhmm")))
    return trips(spark, sf_dir).select("trip_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"))


# orders spread over the hours of their day, in four zones, so that all clock changes of seven years occur
_ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles"]
_ZONED = """z AS (
  SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS local,
         CASE o_custkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
              WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS zone
  FROM orders
)"""


def _utc_sql(local: str, zone: str) -> str:
    """UTC wall time of a local time by its own rule: skipped times move on, double times are null."""
    u = f"(timezone({zone}, {local}) AT TIME ZONE 'UTC')"
    back = lambda t: f"timezone({zone}, timezone('UTC', {t}))"
    return f"""CASE WHEN {back(u)} <> {local} THEN date_trunc('hour', {u})
      WHEN {back(f"({u} + INTERVAL 1 HOUR)")} = {local} OR {back(f"({u} - INTERVAL 1 HOUR)")} = {local} THEN NULL
      ELSE {u} END"""


def _zoned(spark, sf_dir):
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("o_custkey") % 4 + 1).cast("int"))
    minutes = ((F.col("o_orderkey") * 37) % 1440).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", clock.date_plus_minutes(F.to_date("o_orderdate"), minutes).alias("local"), zone.alias("zone")
    )


@query("local_to_utc", f"""WITH {_ZONED}
SELECT o_orderkey, CAST(epoch({_utc_sql("local", "zone")}) AS DOUBLE) AS utc_seconds FROM z""")
def local_to_utc(spark, sf_dir):
    utc = clock.local_to_utc(F.col("local"), F.col("zone"))
    return _zoned(spark, sf_dir).select("o_orderkey", F.unix_seconds(utc).cast("double").alias("utc_seconds"))


# early hours of the orders' days, in zones that change by half an hour, by an hour at other hours, and not at all
_ODD_ZONES = ["Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu", "Europe/Lisbon", "Pacific/Chatham"]
_SHOWN = "timezone(zone, timezone('UTC', x))"


@query("local_to_utc_any_shift", f"""
WITH z AS (
  SELECT o_orderkey, ['{"', '".join(_ODD_ZONES)}'][o_custkey % {len(_ODD_ZONES)} + 1] AS zone,
         date_trunc('day', o_orderdate) + to_minutes((o_orderkey * 7) % 240) AS local FROM orders
),
c AS (
  SELECT o_orderkey, zone, local, list_filter(list_transform(range(-60, 61), lambda k: local + to_minutes(15 * k)), lambda x: {_SHOWN} = local) AS found FROM z
),
gaps AS (
  SELECT o_orderkey, list_min(list_filter(list_transform(range(-900, 901), lambda k: date_trunc('hour', local) + to_minutes(k)), lambda x: {_SHOWN} > local)) AS next
  FROM c WHERE len(found) = 0
)
SELECT o_orderkey, zone, CAST(epoch(CASE len(found) WHEN 0 THEN next WHEN 1 THEN found[1] END) AS DOUBLE) AS utc_seconds, len(found) AS times
FROM c LEFT JOIN gaps USING (o_orderkey)""")
def local_to_utc_any_shift(spark, sf_dir):
    """In SQL by trying all offsets; how often the clock shows a time tells gaps (0) and overlaps (2)."""
    zone = F.element_at(F.array(*[F.lit(z) for z in _ODD_ZONES]), (F.col("o_custkey") % len(_ODD_ZONES) + 1).cast("int"))
    minutes = ((F.col("o_orderkey") * 7) % 240).cast("int")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", clock.date_plus_minutes(F.to_date("o_orderdate"), minutes).alias("local"), zone.alias("zone")
    )
    utc = clock.local_to_utc(F.col("local"), F.col("zone"))
    skipped = F.from_utc_timestamp("utc", F.col("zone")) != F.col("local").cast("timestamp")
    times = F.when(F.col("utc").isNull(), 2).when(skipped, 0).otherwise(1).cast("bigint")
    return df.withColumn("utc", utc).select("o_orderkey", "zone", F.unix_seconds("utc").cast("double").alias("utc_seconds"), times.alias("times"))


@query("roll_next_day", f"""WITH {_ZONED}, b AS (
  SELECT o_orderkey, zone, local AS dep_local, date_trunc('day', local) + to_minutes((o_orderkey * 53) % 1440) AS arr_local FROM z
), u AS (SELECT *, {_utc_sql("dep_local", "zone")} AS dep, {_utc_sql("arr_local", "zone")} AS arr FROM b)
SELECT o_orderkey, CAST(epoch(CASE WHEN arr < dep - INTERVAL 2 HOUR THEN {_utc_sql("(arr_local + INTERVAL 1 DAY)", "zone")} ELSE arr END) AS DOUBLE) AS arrival,
       CAST(epoch(CASE WHEN arr < dep - INTERVAL 2 HOUR THEN arr_local + INTERVAL 1 DAY ELSE arr_local END) AS DOUBLE) AS arrival_local
FROM u""")
def roll_next_day(spark, sf_dir):
    df = _zoned(spark, sf_dir)
    minutes = ((F.col("o_orderkey") * 53) % 1440).cast("int")
    df = df.withColumn("arr_local", clock.date_plus_minutes(F.to_date("local"), minutes))
    df = df.withColumns({
        "dep": clock.local_to_utc(F.col("local"), F.col("zone")), "arr": clock.local_to_utc(F.col("arr_local"), F.col("zone")),
    })
    local, utc = clock.rolled_arrival(F.col("dep"), F.col("arr"), F.col("arr_local"), F.col("zone"))
    return df.select(
        "o_orderkey", F.unix_seconds(utc).cast("double").alias("arrival"),
        F.unix_seconds(local.cast("timestamp")).cast("double").alias("arrival_local"),
    )


@query("calendar_flags", """
SELECT o_orderkey, month(o_orderdate) AS month, isodow(o_orderdate) AS weekday,
       CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS weekend,
       CASE WHEN o_orderkey % 24 BETWEEN 6 AND 9 THEN 1 ELSE 0 END AS peak,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
            WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
FROM orders""")
def calendar_flags(spark, sf_dir):
    weekday = clock.weekday_number(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.month("o_orderdate").cast("bigint").alias("month"), weekday.cast("bigint").alias("weekday"),
        clock.is_weekend(weekday).alias("weekend"), clock.is_peak_hour(F.col("o_orderkey") % 24).alias("peak"),
        clock.season_of_month(F.month("o_orderdate")).alias("season"),
    )


_HOLIDAYS = ", ".join(
    f"DATE '{d:%Y-%m-%d}'" for d in USFederalHolidayCalendar().holidays(pd.Timestamp("1994-12-01"), pd.Timestamp("2002-01-31"))
)


@query("holiday_flags", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders,
       CASE WHEN CAST(o_orderdate AS DATE) IN ({_HOLIDAYS}) THEN 1 ELSE 0 END AS holiday
FROM orders GROUP BY ALL""")
def holiday_flags(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), clock.is_us_federal_holiday(day).alias("holiday")
    ).agg(F.count(F.lit(1)).alias("orders"))


@query("season_interaction", """
SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'spring'
            WHEN month(l_shipdate) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
       round(sum(CAST(coalesce(nullif(l_discount, 0.05), 0) * (CASE WHEN l_linenumber BETWEEN 6 AND 9 THEN 1 ELSE 0 END) AS DECIMAL(18,2)))::DOUBLE, 4) AS amount,
       count(*) AS rows
FROM lineitem GROUP BY 1""")
def season_interaction(spark, sf_dir):
    amount = values.interaction(F.nullif("l_discount", F.lit(0.05)), clock.is_peak_hour(F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy(clock.season_of_month(F.month("l_shipdate")).alias("season")).agg(
        F.round(F.sum(values.exact(amount)).cast("double"), 4).alias("amount"), F.count(F.lit(1)).alias("rows")
    )


@query("floor_hour_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS rows FROM events GROUP BY 1")
def floor_hour_counts(spark, sf_dir):
    hour = F.unix_seconds(clock.floor_hour(F.col("ts"))).alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour).agg(F.count(F.lit(1)).alias("rows"))


@query("route_keys", with_views(TRIPS) + """
SELECT CASE WHEN tail IS NULL THEN NULL ELSE tail || '_' || dest END AS strict_route, coalesce(tail, 'UNK') || '_' || dest AS filled_route,
       count(*) AS rows FROM trips GROUP BY 1, 2""")
def route_keys(spark, sf_dir):
    return trips(spark, sf_dir).groupBy(
        clock.route_key(F.col("tail"), F.col("dest")).alias("strict_route"),
        clock.route_key(F.col("tail"), F.col("dest"), missing="UNK").alias("filled_route"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("month_coverage", """
WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders)
SELECT year(m) AS year, month(m) AS month, (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = m) AS orders
FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)""")
def month_coverage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    months = clock.month_sequence(spark, (lo.year, lo.month), (hi.year, hi.month))
    counts = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    joined = months.join(counts, ["year", "month"], "left").fillna(0, subset=["orders"])
    return joined.select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "orders")


# --- packed fields ---------------------------------------------------------------------
_PART = "trim(split_part(tmp_raw, ',', 1))"


@query("compound_parse", with_views(OBS) + f"""
SELECT obs_id,
       CASE WHEN regexp_replace({_PART}, '^[+-]', '') IN ('9999', '99999', '999999') THEN NULL ELSE TRY_CAST({_PART} AS DOUBLE) / 10 END AS value,
       CASE WHEN {_PART} IN ('9999', '99999', '999999') THEN NULL ELSE TRY_CAST({_PART} AS DOUBLE) / 10 END AS compat_value,
       trim(split_part(tmp_raw, ',', 2)) AS quality, coalesce({_PART}, '') AS compat_text, CAST(NULL AS DOUBLE) AS absent_part
FROM obs""")
def compound_parse(spark, sf_dir):
    raw = F.col("tmp_raw")
    return obs(spark, sf_dir).select(
        "obs_id", values.compound_numeric(raw, 0, 10.0).alias("value"),
        values.compound_numeric(raw, 0, 10.0, reference_compat=True).alias("compat_value"),
        values.compound_text(raw, 1).alias("quality"),
        values.compound_text(raw, 0, reference_compat=True).alias("compat_text"),
        values.compound_numeric(raw, 5).alias("absent_part"),
    )


@query("humidity", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, count(*) AS rows,
       round(min(100 * exp(17.625 * (l_quantity - 20) / (243.04 + l_quantity - 20)) / exp(17.625 * (l_linenumber * 4.0) / (243.04 + l_linenumber * 4.0))), 6) AS humidity
FROM lineitem GROUP BY ALL""")
def humidity(spark, sf_dir):
    h = values.relative_humidity(F.col("l_linenumber") * 4.0, F.col("l_quantity") - 20)
    return table(spark, sf_dir, "lineitem").groupBy(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    ).agg(F.count(F.lit(1)).alias("rows"), F.round(F.min(h), 6).alias("humidity"))


@query("first_present", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 5 = 0 THEN value + 1 END, CASE WHEN event_id % 7 = 0 THEN -1.0 END) AS first_value
FROM events""")
def first_present(spark, sf_dir):
    k = F.col("event_id")
    options = [F.when(k % 3 == 0, F.col("value")), F.when(k % 5 == 0, F.col("value") + 1), F.when(k % 7 == 0, F.lit(-1.0))]
    return table(spark, sf_dir, "events").select("event_id", values.first_present(options).alias("first_value"))


@query("threshold_and_clip", with_views(TRIPS) + """
SELECT trip_id, CASE WHEN dep_delay >= 15 THEN 1 ELSE 0 END AS late, CASE WHEN dep_delay < 0 THEN 0.0 ELSE dep_delay END AS late_minutes,
       CASE WHEN dep_delay < 0 THEN 0.0 WHEN dep_delay > 240 THEN 240.0 ELSE dep_delay END AS clipped
FROM trips""")
def threshold_and_clip(spark, sf_dir):
    d = F.col("dep_delay")
    return trips(spark, sf_dir).select(
        "trip_id", values.threshold_label(d).alias("late"), values.clip(d, low=0.0).alias("late_minutes"),
        values.clip(d, 0.0, 240.0).alias("clipped"),
    )


@query("coerced_numbers", with_views(OBS) + """
SELECT obs_id, TRY_CAST(tmp_raw AS DOUBLE) AS packed, TRY_CAST(split_part(tmp_raw, ',', 1) AS DOUBLE) AS part FROM obs""")
def coerced_numbers(spark, sf_dir):
    from punctual.operators.project import coerce_numeric

    df = obs(spark, sf_dir).select("obs_id", F.col("tmp_raw").alias("packed"), F.substring_index("tmp_raw", ",", 1).alias("part"))
    return coerce_numeric(df, ["packed", "part"])


# --- texts -----------------------------------------------------------------------------
_NUM = "CASE WHEN {c} IS NULL THEN 'NA' ELSE printf('%.2f', CAST({c} AS DOUBLE)) END"


def _row_sql(columns: list[str]) -> str:
    labels = [
        "distance_miles", "origin_temp_c", "origin_visibility_m", "origin_wind_speed_mps", "origin_precip_mm",
        "origin_ceiling_m", "origin_humidity_pct", "prior_origin_avg_delay", "prior_carrier_route_avg_delay",
        "origin_congestion_proxy",
    ]
    parts = [f"'; {n}=' || {_NUM.format(c=c)}" for n, c in zip(labels, columns)]
    return (
        "'origin=' || origin || '; dest=' || dest || '; carrier=' || carrier || '; dep_hour_local=' "
        "|| CAST(hour(dep_ts) AS VARCHAR) || " + " || ".join(parts)
    )


_PROMPT_COLUMNS = [
    "distance", "dep_delay / 40", "distance / 8.0", "dep_delay / 200", "distance / 1000.0", "dep_delay / 8",
    "-dep_delay / 16", "dep_delay", "CAST(NULL AS DOUBLE)", "trip_id",
]
_ROW_SQL = _row_sql(_PROMPT_COLUMNS)


def prompt_frame(spark, sf_dir):
    d, k = F.col("dep_delay"), F.col("distance")
    measures = [k, d / 40, k / 8.0, d / 200, k / 1000.0, d / 8, -d / 16, d, F.lit(None).cast("double"), F.col("trip_id")]
    from punctual.contracts import PROMPT_FIELDS

    return trips(spark, sf_dir).select(
        "trip_id", "delayed", "dep_ts", F.col("origin").alias("Origin"), F.col("dest").alias("Dest"),
        F.col("carrier").alias("Reporting_Airline"), F.hour("dep_ts").alias("scheduled_departure_hour_local"),
        *[m.cast("double").alias(c) for m, (_, c) in zip(measures, PROMPT_FIELDS)],
    )


@query("prompt_rows", with_views(TRIPS) + f"SELECT trip_id, {_ROW_SQL} AS text FROM trips")
def prompt_rows(spark, sf_dir):
    return prompt_frame(spark, sf_dir).select("trip_id", values.row_text({}).alias("text"))


@query("parsed_labels", """
SELECT conv_id, turn,
       CAST(CASE WHEN strpos(upper(text), 'ON_TIME') > 0 AND (strpos(upper(text), 'DELAY') = 0 OR strpos(upper(text), 'ON_TIME') < strpos(upper(text), 'DELAY')) THEN 0
            WHEN strpos(upper(text), 'DELAY') > 0 THEN 1 WHEN strpos(upper(text), 'YES') > 0 THEN 1
            WHEN strpos(upper(text), 'NO') > 0 THEN 0 END AS DOUBLE) AS label
FROM conversations""")
def parsed_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", values.parse_label(F.col("text")).cast("double").alias("label")
    )


@query("slug", """
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", values.slugify(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug")
    )


@query("amount_buckets", """
SELECT bucket, coalesce(n, 0) AS rows FROM (VALUES ('0'), ('(0,1]'), ('(1,5]'), ('(5,10]'), ('10+')) AS b(bucket)
LEFT JOIN (SELECT CASE WHEN v > -0.001 AND v <= 0 THEN '0' WHEN v > 0 AND v <= 1 THEN '(0,1]' WHEN v > 1 AND v <= 5 THEN '(1,5]'
                       WHEN v > 5 AND v <= 10 THEN '(5,10]' WHEN v > 10 THEN '10+' END AS bucket, count(*) AS n
           FROM (SELECT coalesce(CASE WHEN event_id % 6 <> 0 THEN floor(value / 10) END, 0) AS v FROM events) GROUP BY 1) USING (bucket)""")
def amount_buckets(spark, sf_dir):
    from punctual.operators.aggregate import rate_by_bucket

    df = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 6 != 0, F.floor(F.col("value") / 10).cast("double")).alias("amount"), F.lit(0).alias("flag")
    )
    return rate_by_bucket(df, "amount", "flag").select("bucket", F.col("flights").alias("rows"))

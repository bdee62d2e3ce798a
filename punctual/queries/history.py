"""History features, as-of matches, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from punctual.operators import history, join, scan, split
from punctual.operators.aggregate import entity_hour_stats, present
from punctual.plans import increment
from punctual.queries.registry import query
from punctual.queries.views import OBS, TRIPS, obs, table, trips, with_views
from punctual.session import shared_folder

_PREV_SQL = with_views(TRIPS) + """
, hourly AS (
  SELECT origin, date_trunc('hour', dep_ts) AS h,
         CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay) AS avg_delay,
         avg(delayed) AS rate
  FROM trips GROUP BY 1, 2
), shifted AS (
  SELECT origin, h, lag(avg_delay) OVER w AS prev_delay,
         avg(rate) OVER (PARTITION BY origin ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev_rate
  FROM hourly WINDOW w AS (PARTITION BY origin ORDER BY h)
)"""


@query("prev_period_features", _PREV_SQL + """
SELECT hour(t.dep_ts) AS dep_hour_of_day, count(*) AS flights,
       round(avg(t.delayed), 6) AS delay_rate,
       count(s.prev_delay) AS with_previous,
       round(avg(s.prev_delay), 6) AS mean_prev_delay,
       round(avg(s.prev_rate), 6) AS mean_prev_rate
FROM trips t LEFT JOIN shifted s ON s.origin = t.origin AND s.h = date_trunc('hour', t.dep_ts)
GROUP BY 1""")
def prev_period_features(spark, sf_dir):
    t = history.previous_period_features(
        trips(spark, sf_dir), "dep_ts", "dep_delay", "delayed", {"origin": "origin"}, rolling=("origin",)
    )
    return t.groupBy(F.hour("dep_ts").cast("bigint").alias("dep_hour_of_day")).agg(
        F.count(F.lit(1)).alias("flights"),
        F.round(F.avg("delayed"), 6).alias("delay_rate"),
        F.count("origin_avg_dep_delay_prev_hour").alias("with_previous"),
        F.round(F.avg("origin_avg_dep_delay_prev_hour"), 6).alias("mean_prev_delay"),
        F.round(F.avg("origin_delay_rate_prev_3h"), 6).alias("mean_prev_rate"),
    )


@query("prev_period_rows", with_views(TRIPS) + """
, h AS (
  SELECT trip_id, origin, carrier, route, date_trunc('hour', dep_ts) AS h, dep_delay, delayed FROM trips
), o AS (
  SELECT origin, h, lag(d) OVER w AS pd,
         avg(r) OVER (PARTITION BY origin ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pr
  FROM (SELECT origin, h, CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay) AS d, avg(delayed) AS r
        FROM h GROUP BY 1, 2) WINDOW w AS (PARTITION BY origin ORDER BY h)
), c AS (
  SELECT carrier, h, lag(d) OVER w AS pd,
         avg(r) OVER (PARTITION BY carrier ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pr
  FROM (SELECT carrier, h, CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay) AS d, avg(delayed) AS r
        FROM h GROUP BY 1, 2) WINDOW w AS (PARTITION BY carrier ORDER BY h)
), r AS (
  SELECT route, h, lag(d) OVER w AS pd
  FROM (SELECT route, h, CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay) AS d
        FROM h GROUP BY 1, 2) WINDOW w AS (PARTITION BY route ORDER BY h)
)
SELECT h.trip_id, round(o.pd, 12) AS origin_prev, round(o.pr, 6) AS origin_rate, round(c.pd, 12) AS carrier_prev,
       round(c.pr, 6) AS carrier_rate, round(r.pd, 12) AS route_prev
FROM h LEFT JOIN o USING (origin, h) LEFT JOIN c ON c.carrier = h.carrier AND c.h = h.h
LEFT JOIN r ON r.route = h.route AND r.h = h.h""")
def prev_period_rows(spark, sf_dir):
    t = history.previous_period_features(
        trips(spark, sf_dir), "dep_ts", "dep_delay", "delayed",
        {"origin": "origin", "carrier": "carrier", "route": "route"}, rolling=("origin", "carrier"),
    )
    return t.select(
        "trip_id",
        F.round("origin_avg_dep_delay_prev_hour", 12).alias("origin_prev"),
        F.round("origin_delay_rate_prev_3h", 6).alias("origin_rate"),
        F.round("carrier_avg_dep_delay_prev_hour", 12).alias("carrier_prev"),
        F.round("carrier_delay_rate_prev_3h", 6).alias("carrier_rate"),
        F.round("route_avg_dep_delay_prev_hour", 12).alias("route_prev"),
    )


@query("entity_hour_stats", with_views(TRIPS) + """
SELECT carrier, epoch(date_trunc('hour', dep_ts))::BIGINT AS hour,
       round(CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay), 6) AS avg_delay,
       round(avg(delayed), 6) AS delay_rate
FROM trips GROUP BY 1, 2""")
def entity_hours(spark, sf_dir):
    stats = entity_hour_stats(trips(spark, sf_dir), "carrier", "dep_ts", "dep_delay", "delayed")
    return stats.select(
        "carrier", F.unix_seconds("hour").alias("hour"),
        F.round("avg_delay", 6).alias("avg_delay"), F.round("delay_rate", 6).alias("delay_rate"),
    )


# --- as-of ----------------------------------------------------------------------------
_ASOF_SQL = with_views(TRIPS, OBS) + """
, l AS (SELECT * FROM trips WHERE carrier <> 'view')
SELECT l.trip_id,
       CASE WHEN o.obs_ts >= l.dep_ts - INTERVAL 3 HOUR THEN CAST(o.obs_id AS DOUBLE) END AS obs_id,
       CASE WHEN o.obs_ts >= l.dep_ts - INTERVAL 3 HOUR THEN CAST(epoch_us(o.obs_ts) AS DOUBLE) END AS obs_us,
       CASE WHEN o.obs_ts >= l.dep_ts - INTERVAL 3 HOUR THEN o.tmp_raw END AS tmp_raw
FROM l ASOF LEFT JOIN obs o ON l.origin = o.station AND l.dep_ts >= o.obs_ts"""


def _asof(spark, sf_dir, buckets=None):
    left = trips(spark, sf_dir).where("carrier <> 'view'")
    payload = {"obs_id": "obs_id", "obs_us": "obs_ts", "tmp_raw": "tmp_raw"}
    return join.asof_join(
        left, obs(spark, sf_dir), "origin", "station", "dep_ts", "obs_ts", payload, "3 HOURS", buckets=buckets
    ).select(
        "trip_id", F.col("obs_id").cast("double").alias("obs_id"),
        F.unix_micros("obs_us").cast("double").alias("obs_us"), "tmp_raw",
    )


@query("asof_backward_tolerance", _ASOF_SQL)
def asof_backward_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir)


@query("asof_hot_key_path", _ASOF_SQL)
def asof_hot_key_path(spark, sf_dir):
    """The same match by the path that large inputs take: range buckets instead of one window."""
    return _asof(spark, sf_dir, buckets=64)


@query("asof_two_sided", with_views(TRIPS, OBS) + """
, l AS (SELECT *, dep_ts + INTERVAL 90 MINUTE AS arr_ts FROM trips WHERE carrier <> 'view'),
m AS (
  SELECT l.*, CASE WHEN o.obs_ts >= l.dep_ts - INTERVAL 3 HOUR THEN o.reading END AS origin_reading
  FROM l ASOF LEFT JOIN obs o ON l.origin = o.station AND l.dep_ts >= o.obs_ts
), n AS (
  SELECT m.*, CASE WHEN o.obs_ts >= m.arr_ts - INTERVAL 3 HOUR THEN o.reading END AS dest_reading
  FROM m ASOF LEFT JOIN obs o ON m.dest = o.station AND m.arr_ts >= o.obs_ts
)
SELECT carrier, count(*) AS flights, round(avg(CASE WHEN origin_reading IS NOT NULL THEN 1 ELSE 0 END), 6) AS origin_join_rate,
       round(avg(CASE WHEN dest_reading IS NOT NULL THEN 1 ELSE 0 END), 6) AS dest_join_rate,
       round(avg(origin_reading), 6) AS origin_mean, round(avg(dest_reading), 6) AS dest_mean
FROM n GROUP BY 1""")
def asof_two_sided(spark, sf_dir):
    left = trips(spark, sf_dir).where("carrier <> 'view'")
    left = left.withColumn("arr_ts", F.col("dep_ts") + F.expr("INTERVAL 90 MINUTES"))
    sides = [("origin", "dep_ts", {"origin_reading": "reading"}), ("dest", "arr_ts", {"dest_reading": "reading"})]
    left = join.asof_join_sides(left, obs(spark, sf_dir), sides, "station", "obs_ts", "3 HOURS")
    return left.groupBy("carrier").agg(
        F.count(F.lit(1)).alias("flights"),
        F.round(present(F.col("origin_reading")), 6).alias("origin_join_rate"),
        F.round(present(F.col("dest_reading")), 6).alias("dest_join_rate"),
        F.round(F.avg("origin_reading"), 6).alias("origin_mean"),
        F.round(F.avg("dest_reading"), 6).alias("dest_mean"),
    )


# --- prior rows -----------------------------------------------------------------------
def _prior_sql(keys: str) -> str:
    return f"""round(CAST(sum(coalesce(CAST(dep_delay AS DECIMAL(18,2)), 0)) OVER
        (PARTITION BY {keys} ORDER BY dep_ts, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE)
      / nullif(count(*) OVER (PARTITION BY {keys} ORDER BY dep_ts, trip_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12)"""


_PRIOR_SQL = with_views(TRIPS) + f"""
SELECT trip_id, {_prior_sql("origin, isodow(trip_date), hour(dep_ts)")} AS by_origin_slot,
       {_prior_sql("carrier, route")} AS by_carrier_route, {_prior_sql("origin, carrier")} AS by_origin_carrier
FROM trips"""


def _prior(spark, sf_dir, buckets=None):
    t = trips(spark, sf_dir).withColumns({"dow": F.weekday("trip_date") + 1, "hod": F.hour("dep_ts")})
    features = {
        "by_origin_slot": ["origin", "dow", "hod"],
        "by_carrier_route": ["carrier", "route"],
        "by_origin_carrier": ["origin", "carrier"],
    }
    out = history.prior_means(t, "dep_ts", "dep_delay", features, ["trip_id"], buckets=buckets)
    return out.select("trip_id", *[F.round(n, 12).alias(n) for n in features])


@query("prior_mean_features", _PRIOR_SQL)
def prior_mean_features(spark, sf_dir):
    return _prior(spark, sf_dir)


@query("prior_mean_hot_key_path", _PRIOR_SQL)
def prior_mean_hot_key_path(spark, sf_dir):
    """The same features by the path that large inputs take."""
    return _prior(spark, sf_dir, buckets=32)


@query("prior_count_in_hour", with_views(TRIPS) + """
SELECT trip_id, row_number() OVER (PARTITION BY origin, date_trunc('hour', dep_ts) ORDER BY dep_ts, trip_id) - 1 AS earlier
FROM trips""")
def prior_count_in_hour(spark, sf_dir):
    out = history.prior_count_in_hour(trips(spark, sf_dir), "dep_ts", "origin", "earlier", ["trip_id"])
    return out.select("trip_id", "earlier")


@query("previous_leg", with_views(TRIPS) + """
SELECT trip_id, p AS previous_delay, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS available
FROM (SELECT trip_id, CASE WHEN tail IS NOT NULL THEN lag(dep_delay) OVER (PARTITION BY tail ORDER BY dep_ts, trip_id) END AS p
      FROM trips)""")
def previous_leg(spark, sf_dir):
    out = history.previous_leg(
        trips(spark, sf_dir), "dep_ts", "tail", "dep_delay", "previous_delay", "available", ["trip_id"]
    )
    return out.select("trip_id", "previous_delay", "available")


@query("previous_leg_compat", with_views(TRIPS) + """
SELECT trip_id, p AS previous_delay, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS available
FROM (SELECT trip_id, lag(dep_delay) OVER (PARTITION BY tail ORDER BY dep_ts, trip_id) AS p FROM trips)""")
def previous_leg_compat(spark, sf_dir):
    """Rows without an entity chained to each other, by the path that large inputs take."""
    out = history.previous_leg(
        trips(spark, sf_dir), "dep_ts", "tail", "dep_delay", "previous_delay", "available", ["trip_id"],
        reference_compat=True, buckets=16,
    )
    return out.select("trip_id", "previous_delay", "available")


PLAN = increment.HistoryPlan(
    time="dep_ts", delay="dep_delay",
    means={"by_carrier_route": ["carrier", "route"], "by_origin_slot": ["origin", "dow", "hod"]},
    entity="origin", count_name="earlier", vehicle="tail", leg_value="dep_delay", leg_name="previous_delay", leg_flag="available",
    tie_order=["trip_id"],
)


@query("incremental_history", with_views(TRIPS) + f"""
SELECT trip_id, {_prior_sql("carrier, route")} AS by_carrier_route, {_prior_sql("origin, isodow(trip_date), hour(dep_ts)")} AS by_origin_slot,
       row_number() OVER (PARTITION BY origin, date_trunc('hour', dep_ts) ORDER BY dep_ts, trip_id) - 1 AS earlier,
       CASE WHEN tail IS NOT NULL THEN lag(dep_delay) OVER (PARTITION BY tail ORDER BY dep_ts, trip_id) END AS previous_delay,
       CASE WHEN tail IS NOT NULL AND lag(dep_delay) OVER (PARTITION BY tail ORDER BY dep_ts, trip_id) IS NOT NULL THEN 1 ELSE 0 END AS available
FROM trips""")
def incremental_history(spark, sf_dir):
    """Three batches, cut inside an hour, each from the saved state of the one before; SQL calculates over all rows at once."""
    t = trips(spark, sf_dir).withColumns({"dow": F.weekday("trip_date") + 1, "hod": F.hour("dep_ts")})
    first, last = t.agg(F.min("dep_ts"), F.max("dep_ts")).first()
    cuts = [first + (last - first) * part for part in (0.35, 0.7)]
    done, state = [], None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = t if low is None else t.where(F.col("dep_ts") > F.lit(low))
        batch = batch if high is None else batch.where(F.col("dep_ts") <= F.lit(high))
        rows, after = increment.continue_history(batch, PLAN, state)
        done.append(rows)
        path = shared_folder(spark)
        after.save(path)
        state = increment.HistoryState.load(spark, path, PLAN)
    out = reduce(lambda a, b: a.unionByName(b), done)
    return out.select("trip_id", *[F.round(n, 12).alias(n) for n in PLAN.means], "earlier", "previous_delay", "available")


# --- splits ---------------------------------------------------------------------------
@query("temporal_split_counts", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
n AS (SELECT greatest(CAST(floor(count(*) * 0.8) AS BIGINT), 1) AS wanted FROM d),
c AS (SELECT d AS cut FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM d), n WHERE pos = wanted)
SELECT CASE WHEN CAST(o_orderdate AS DATE) < cut THEN 'train' ELSE 'test' END AS role,
       strftime(cut, '%Y-%m-%d') AS cut, count(*) AS orders, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
FROM orders, c GROUP BY 1, 2""")
def temporal_split_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cut = F.date_format(split.cut_date(orders, "o_orderdate").scalar(), "yyyy-MM-dd")
    return (
        split.with_split_role(orders, "o_orderdate")
        .groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"),
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"),
        )
        .withColumn("cut", cut)
    )


@query("temporal_folds_counts", """
WITH d AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n
           FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
f AS (SELECT d, fold, CASE WHEN pos < (fold * n) // 5 THEN 'train' WHEN pos < ((fold + 1) * n) // 5 THEN 'test' END AS role
      FROM d, (SELECT unnest([1, 2, 3, 4]) AS fold))
SELECT fold, role, count(*) AS orders, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
FROM orders JOIN f ON CAST(o_orderdate AS DATE) = f.d WHERE role IS NOT NULL GROUP BY 1, 2""")
def temporal_folds_counts(spark, sf_dir):
    folds = split.with_folds(table(spark, sf_dir, "orders"), "o_orderdate", 4)
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("orders"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"),
    )


@query("running_total_order", with_views(TRIPS) + """
SELECT trip_id, row_number() OVER (ORDER BY dep_ts, trip_id) - 1 AS position FROM trips""")
def running_total_order(spark, sf_dir):
    """Global position of every row in time order, without a one-task window."""
    s = scan.OrderedScan(trips(spark, sf_dir), [], ["dep_ts", "trip_id"], buckets=16).prior_count("position")
    return s.result().select("trip_id", "position")

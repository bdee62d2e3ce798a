"""Profiles, quality figures and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import aggregate, project, quantile, split
from punctual.plans import quality
from punctual.queries.registry import query
from punctual.queries.views import OBS, TRIPS, obs, table, trips, with_views


def _rate_sql(key: str, alias: str, where: str = "") -> str:
    return with_views(TRIPS) + f"""
SELECT {key} AS {alias}, round(avg(delayed), 6) AS delay_rate, count(*) AS flights FROM trips {where} GROUP BY 1"""


def _rounded(df):
    return df.withColumn("delay_rate", F.round("delay_rate", 6))


@query("rate_by_hour", _rate_sql("hour(dep_ts)", "hour"))
def rate_by_hour(spark, sf_dir):
    hour = F.hour("dep_ts").cast("bigint")
    return _rounded(aggregate.rate_by(trips(spark, sf_dir), hour, "delayed", keep_null=False, name="hour"))


@query("rate_by_month", """
SELECT month(o_orderdate) AS month, round(avg(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END), 6) AS delay_rate, count(*) AS flights FROM orders GROUP BY 1""")
def rate_by_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("late", (F.col("o_totalprice") >= 250000).cast("int"))
    month = F.month("o_orderdate").cast("bigint")
    return _rounded(aggregate.rate_by(orders, month, "late", keep_null=False, name="month"))


@query("rate_by_carrier", _rate_sql("carrier", "carrier"))
def rate_by_carrier(spark, sf_dir):
    return _rounded(aggregate.rate_by(trips(spark, sf_dir), "carrier", "delayed"))


@query("rate_by_tail", _rate_sql("tail", "tail"))
def rate_by_tail(spark, sf_dir):
    """The null key is a group."""
    return _rounded(aggregate.rate_by(trips(spark, sf_dir), "tail", "delayed"))


@query("top_origins_by_volume", with_views(TRIPS) + """
SELECT * FROM (SELECT origin, round(avg(delayed), 6) AS delay_rate, count(*) AS flights FROM trips GROUP BY 1 ORDER BY flights DESC, origin LIMIT 15)
ORDER BY delay_rate, origin""")
def top_origins_by_volume(spark, sf_dir):
    return aggregate.top_then_resort(_rounded(aggregate.rate_by(trips(spark, sf_dir), "origin", "delayed")))


@query("precip_buckets", with_views(TRIPS) + """
, b AS (SELECT CASE WHEN v > -0.001 AND v <= 0 THEN '0' WHEN v > 0 AND v <= 1 THEN '(0,1]' WHEN v > 1 AND v <= 5 THEN '(1,5]'
               WHEN v > 5 AND v <= 10 THEN '(5,10]' WHEN v > 10 THEN '10+' END AS bucket, delayed
        FROM (SELECT CASE WHEN distance < 12 THEN CAST(distance AS DOUBLE) ELSE 0 END AS v, delayed FROM trips))
SELECT bucket, round(avg(delayed), 6) AS delay_rate, count(delayed) AS flights
FROM (VALUES ('0'), ('(0,1]'), ('(1,5]'), ('(5,10]'), ('10+')) AS l(bucket) LEFT JOIN b USING (bucket) GROUP BY 1""")
def precip_buckets(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("precip", F.when(F.col("distance") < 12, F.col("distance").cast("double")))
    return _rounded(aggregate.rate_by_bucket(t, "precip", "delayed"))


@query("count_mean_median", with_views(TRIPS) + """
SELECT tail, count(dep_delay) AS count, round(CAST(sum(CAST(dep_delay AS DECIMAL(18,2))) AS DOUBLE) / count(dep_delay), 12) AS mean,
       round(median(dep_delay), 12) AS median FROM trips GROUP BY 1""")
def count_mean_median(spark, sf_dir):
    return aggregate.count_mean_median(trips(spark, sf_dir), "tail", "dep_delay", digits=12)


@query("group_mean_flags", with_views(TRIPS) + """
SELECT carrier, round(avg(delayed), 4) AS delayed, round(avg(CASE WHEN distance > 50 THEN 1 ELSE 0 END), 4) AS far FROM trips GROUP BY 1""")
def group_mean_flags(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("far", (F.col("distance") > 50).cast("int"))
    return aggregate.group_mean_flags(t, "carrier", ["delayed", "far"])


@query("duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicates(spark, sf_dir):
    return aggregate.duplicate_count(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return aggregate.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_shipdate")


@query("missing_rates", with_views(TRIPS) + """
SELECT 'tail' AS feature, round(avg(CASE WHEN tail IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate FROM trips
UNION ALL SELECT 'dep_delay', round(avg(CASE WHEN dep_delay IS NULL THEN 1 ELSE 0 END), 6) FROM trips
UNION ALL SELECT 'distance', round(avg(CASE WHEN distance IS NULL THEN 1 ELSE 0 END), 6) FROM trips""")
def missing_rates(spark, sf_dir):
    rates = aggregate.missing_rates(trips(spark, sf_dir), ["tail", "dep_delay", "distance"], top=15)
    return rates.withColumn("missing_rate", F.round("missing_rate", 6))


@query("value_counts", with_views(TRIPS) + """
SELECT tail, count(*) AS rows, round(count(*) / (SELECT count(*) FROM trips), 8) AS share FROM trips GROUP BY 1""")
def value_counts(spark, sf_dir):
    return aggregate.value_counts(trips(spark, sf_dir), "tail").withColumn("share", F.round("share", 8))


@query("entity_profile", with_views(TRIPS) + """
SELECT tail, count(*) AS flights, round(avg(delayed), 6) AS delay_rate, round(coalesce(avg(CASE WHEN distance % 2 = 0 THEN distance END), 0), 6) AS avg_distance,
       round(coalesce(avg(CASE WHEN tail = 'T7' THEN NULL ELSE dep_delay END), 0), 6) AS avg_delay FROM trips GROUP BY 1""")
def entity_profile(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({
        "even": F.when(F.col("distance") % 2 == 0, F.col("distance").cast("double")),
        "known": F.when(F.col("tail").isNull() | (F.col("tail") != "T7"), F.col("dep_delay")),
    })
    profile = aggregate.entity_profile(t, "tail", "delayed", {"avg_distance": "even", "avg_delay": "known"})
    return profile.withColumns({c: F.round(c, 6) for c in ("delay_rate", "avg_distance", "avg_delay")})


@query("cluster_table", "SELECT label AS cluster, count(*) AS members, round(avg(embedding[1]), 5) AS x, round(avg(embedding[2]), 5) AS y FROM embeddings GROUP BY 1")
def cluster_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("cluster"), F.get("embedding", 0).cast("double").alias("a"), F.get("embedding", 1).cast("double").alias("b")
    )
    out = aggregate.cluster_summary(e, {"x": "a", "y": "b"})
    return out.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


@query("fold_summary", with_views(TRIPS) + """
, f AS (SELECT carrier AS model, trip_date AS fold, avg(delayed) AS f1, avg(distance / 100.0) AS pr_auc FROM trips GROUP BY 1, 2)
SELECT model, round(avg(f1), 6) AS f1_mean, round(avg(pr_auc), 6) AS pr_auc_mean, round(stddev_samp(f1), 6) AS f1_std, round(stddev_samp(pr_auc), 6) AS pr_auc_std FROM f GROUP BY 1""")
def fold_summary(spark, sf_dir):
    folds = trips(spark, sf_dir).groupBy(F.col("carrier").alias("model"), F.col("trip_date").alias("fold")).agg(
        F.avg("delayed").alias("f1"), F.avg(F.col("distance") / 100.0).alias("pr_auc")
    )
    out = aggregate.fold_summary(folds, ["f1", "pr_auc"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "model"})


@query("corrected_skewness", """
SELECT 'l_extendedprice' AS feature, round(skewness(l_extendedprice), 6) AS skew FROM lineitem
UNION ALL SELECT 'l_discount', round(skewness(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', round(skewness(l_quantity), 6) FROM lineitem""")
def corrected_skewness(spark, sf_dir):
    out = aggregate.skewness_table(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount", "l_quantity"], top=15)
    return out.withColumn("skew", F.round("skew", 6))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pairwise_corr", "\nUNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _LI for b in _LI
))
def pairwise_corr(spark, sf_dir):
    return aggregate.pearson_matrix(table(spark, sf_dir, "lineitem"), _LI).withColumn("corr", F.round("corr", 6))


@query("corr_dense_rank", with_views(TRIPS) + """
, c AS (SELECT 'distance' AS feature, corr(distance, dep_delay) AS r FROM trips UNION ALL SELECT 'hour', corr(hour(dep_ts), dep_delay) FROM trips
        UNION ALL SELECT 'weekday', corr(isodow(trip_date), dep_delay) FROM trips UNION ALL SELECT 'constant', NULL)
SELECT feature, round(r, 6) AS corr, CAST(CASE WHEN r IS NOT NULL THEN dense_rank() OVER (ORDER BY abs(r) DESC NULLS LAST) END AS DOUBLE) AS rank FROM c""")
def corr_dense_rank(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({
        "hour": F.hour("dep_ts"), "weekday": F.weekday("trip_date") + 1, "constant": F.lit(None).cast("double"),
    })
    corr = aggregate.pearson_with(t, ["distance", "hour", "weekday", "constant"], ["dep_delay"])
    ranked = aggregate.dense_rank_abs(corr, "dep_delay", "rank")
    return ranked.select("feature", F.round("dep_delay", 6).alias("corr"), F.col("rank").cast("double").alias("rank"))


@query("histogram_minutes", with_views(TRIPS) + """
SELECT CAST(least(floor(greatest(0, least(dep_delay, 240)) / 4), 59) AS INTEGER) AS bin, count(*) AS rows FROM trips WHERE dep_delay IS NOT NULL GROUP BY 1""")
def histogram_minutes(spark, sf_dir):
    return aggregate.histogram(trips(spark, sf_dir), "dep_delay")


@query("stage_reduction", """
WITH s AS (SELECT 1 AS position, 'all' AS stage, count(*) AS rows FROM lineitem
  UNION ALL SELECT 2, 'shipped', count(*) FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 3, 'returned', count(*) FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R')
SELECT stage, rows, CAST(lag(rows) OVER w - rows AS DOUBLE) AS rows_removed_from_previous, round(rows / lag(rows) OVER w, 8) AS share_retained_from_previous,
       round(rows / first(rows) OVER w, 8) AS share_retained_from_full FROM s WINDOW w AS (ORDER BY position)""")
def stage_reduction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    counts = li.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("l_linestatus") == "F").alias("shipped"),
        F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("returned"),
    )
    stages = counts.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("rows")) for s in counts.columns])))
    stages = stages.select(F.col("pos").alias("position"), "col.stage", "col.rows")
    out = aggregate.stage_reduction(stages)
    return out.select(
        "stage", "rows", F.col("rows_removed_from_previous").cast("double").alias("rows_removed_from_previous"),
        F.round("share_retained_from_previous", 8).alias("share_retained_from_previous"),
        F.round("share_retained_from_full", 8).alias("share_retained_from_full"),
    )


_Q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def _quantile_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS feature, CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 6) AS quantile FROM lineitem GROUP BY 1"
        for c in ("l_extendedprice", "l_quantity") for p in _Q
    )


@query("exact_quantiles", _quantile_sql())
def exact_quantiles(spark, sf_dir):
    out = quantile.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], _Q, keys=["l_returnflag"])
    return out.withColumn("quantile", F.round("quantile", 6))


@query("exact_quantiles_hot_key_path", _quantile_sql())
def exact_quantiles_hot_key_path(spark, sf_dir):
    """The same by the path that large inputs take: coarse sketches, gaps narrowed down pass by pass."""
    out = quantile.exact_quantiles(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], _Q, keys=["l_returnflag"], keep=30, accuracy=20
    )
    return out.withColumn("quantile", F.round("quantile", 6))


# --- reports --------------------------------------------------------------------------------
@query("dataset_summary", with_views(TRIPS) + """
SELECT 'trips' AS dataset, count(*) AS rows, count(DISTINCT origin) AS unique_origins, count(DISTINCT dest) AS unique_destinations,
       strftime(min(trip_date), '%Y-%m-%d') AS date_start, strftime(max(trip_date), '%Y-%m-%d') AS date_end,
       round(avg(delayed), 6) AS delay_rate, round(avg(CASE WHEN dep_delay IS NOT NULL THEN 1 ELSE 0 END), 6) AS present_dep_delay,
       round(avg(CASE WHEN tail IS NOT NULL THEN 1 ELSE 0 END), 6) AS present_tail,
       round(avg(CASE WHEN tail IS NULL THEN 1 ELSE 0 END), 6) AS missing_tail,
       round(avg(CASE WHEN hour(dep_ts) BETWEEN 6 AND 11 THEN delayed END), 6) AS morning_delay_rate,
       round(avg(CASE WHEN hour(dep_ts) BETWEEN 17 AND 22 THEN delayed END), 6) AS evening_delay_rate,
       round(avg(CASE WHEN distance > 80 THEN delayed END), 6) AS bad_weather_delay_rate,
       (SELECT string_agg(origin, ', ' ORDER BY n DESC, origin) FROM (SELECT origin, count(*) AS n FROM trips GROUP BY 1 ORDER BY n DESC, origin LIMIT 10)) AS top_10_origins
FROM trips""")
def dataset_summary(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({"hour": F.hour("dep_ts"), "rain": F.greatest(F.col("distance") - 80, F.lit(0))})
    out = quality.dataset_summary(
        t, "trips", origin="origin", dest="dest", day="trip_date", flag="delayed", hour="hour", rain="rain",
        present=["dep_delay", "tail"], missing=["tail"],
    )
    rounded = {c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"}
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("date_start", "date_end")}
    return out.withColumns(rounded | dates)


@query("quality_report", with_views(TRIPS, OBS) + """
, d AS (SELECT sum(n - 1) AS v FROM (SELECT count(*) AS n FROM trips GROUP BY trip_date, carrier, origin, dest))
SELECT 'flights_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM trips
UNION ALL SELECT 'weather_rows', CAST(count(*) AS DOUBLE) FROM obs
UNION ALL SELECT 'duplicate_flights', CAST(v AS DOUBLE) FROM d
UNION ALL SELECT 'malformed_dep_hhmm', CAST(count(*) FILTER (CAST(substr(dep_hhmm, 1, 2) AS INTEGER) > 24 OR CAST(substr(dep_hhmm, 3) AS INTEGER) > 59 OR (substr(dep_hhmm, 1, 2) = '24' AND substr(dep_hhmm, 3) <> '00')) AS DOUBLE) FROM trips
UNION ALL SELECT 'missing_share_dep_delay', round(avg(CASE WHEN dep_delay IS NULL THEN 1 ELSE 0 END), 6) FROM trips
UNION ALL SELECT 'missing_share_tail', round(avg(CASE WHEN tail IS NULL THEN 1 ELSE 0 END), 6) FROM trips
UNION ALL SELECT 'positive_share_delayed', round(avg(delayed), 6) FROM trips""")
def quality_report(spark, sf_dir):
    t = trips(spark, sf_dir)
    out = quality.quality_figures(
        t, obs(spark, sf_dir), duplicate_key=["trip_date", "carrier", "origin", "dest"], clock_columns=["dep_hhmm"],
        missing=["dep_delay", "tail"], flags=["delayed"],
    )
    return out.withColumn("value", F.round("value", 6))


@query("feature_type_counts", with_views(TRIPS) + """
SELECT 'categorical' AS feature_type, CASE WHEN count(tail) > 0 THEN 2 ELSE 1 END::BIGINT AS count FROM trips
UNION ALL SELECT 'numeric', (CASE WHEN count(dep_delay) > 0 THEN 1 ELSE 0 END + CASE WHEN count(distance) > 0 THEN 1 ELSE 0 END)::BIGINT FROM trips
UNION ALL SELECT 'total_model_features', (CASE WHEN count(tail) > 0 THEN 2 ELSE 1 END + CASE WHEN count(dep_delay) > 0 THEN 1 ELSE 0 END
                  + CASE WHEN count(distance) > 0 THEN 1 ELSE 0 END)::BIGINT FROM trips""")
def feature_type_counts(spark, sf_dir):
    """Features of each kind that are left after columns without any value are dropped."""
    t = trips(spark, sf_dir).withColumn("void", F.lit(None).cast("double"))
    live = project.non_null_features(t, ["dep_delay", "void", "distance"])
    return quality.feature_type_counts(t, ["tail", "origin"], live)


@query("sample_cap_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 15) AS BIGINT),
         l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20000""")
def sample_cap_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    identity = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return split.sample_cap(li, 20000, identity).select(*identity)


@query("stratified_take", with_views(TRIPS) + """
, ranked AS (SELECT trip_id, delayed, dep_delay,
    row_number() OVER (PARTITION BY delayed ORDER BY CAST('0x' || substr(md5('42|' || trip_id), 1, 15) AS BIGINT), trip_id) AS place FROM trips)
SELECT trip_id, delayed, dep_delay FROM ranked WHERE place <= CASE delayed WHEN 0 THEN 40 ELSE 25 END""")
def stratified_take(spark, sf_dir):
    t = trips(spark, sf_dir).select("trip_id", "delayed", "dep_delay")
    return split.stratified_take(t, "delayed", {0: 40, 1: 25}, ["trip_id"])

"""Preparation, evaluation and model runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.learn import evaluate, importance, information, models, nearest, prep, smote, stats
from punctual.operators import split
from punctual.operators.aggregate import entity_profile
from punctual.plans import features, prompts
from punctual.queries.registry import query
from punctual.queries.values import _ROW_SQL, prompt_frame
from punctual.queries.views import TRIPS, table, trips, with_views
from punctual.session import spread

# --- metrics on a given predictions table ---------------------------------------------------
PREDICTIONS = """
predictions AS (
  SELECT carrier AS model, trip_id AS id, delayed AS y, distance / 100.0 AS score,
         CASE WHEN trip_id % 13 = 0 THEN NULL WHEN distance >= 50 THEN 1 ELSE 0 END AS pred FROM trips
)"""


def predictions(spark, sf_dir):
    return trips(spark, sf_dir).select(
        F.col("carrier").alias("model"), F.col("trip_id").alias("id"), F.col("delayed").alias("y"),
        (F.col("distance") / F.lit(100.0)).alias("score"),
        F.when(F.col("trip_id") % 13 != 0, (F.col("distance") >= 50).cast("int")).alias("pred"),
    )


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_RATIO = "round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"


def _prf_sql(tp="tp", fp="fp", fn="fn"):
    return (
        f"{_RATIO.format(a=tp, b=f'{tp} + {fp}')} AS precision, {_RATIO.format(a=tp, b=f'{tp} + {fn}')} AS recall, "
        f"{_RATIO.format(a=f'2 * {tp}', b=f'2 * {tp} + {fp} + {fn}')} AS f1"
    )


def _counts_sql(hit):
    return f"""count(*) FILTER (y = 1 AND {hit}) AS tp, count(*) FILTER (y = 0 AND {hit}) AS fp,
       count(*) FILTER (y = 1 AND NOT ({hit})) AS fn, count(*) FILTER (y = 0 AND NOT ({hit})) AS tn"""


@query("class_metrics", with_views(TRIPS, PREDICTIONS) + f"""
SELECT model, {_prf_sql()} FROM (SELECT model, {_counts_sql("score >= 0.5")} FROM predictions GROUP BY 1)""")
def class_metrics(spark, sf_dir):
    return _round(evaluate.class_metrics(predictions(spark, sf_dir), ["model"]), "precision", "recall", "f1")


_RANKED = """
g AS (SELECT model, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS tp, coalesce(sum(neg) OVER w, 0) AS fp,
             sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
      FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_AUC = with_views(TRIPS, PREDICTIONS, _RANKED) + """
SELECT model, round(sum(neg * (tp + pos / 2)) / (max(p) * max(n)), 6) AS roc_auc FROM r GROUP BY 1"""
_AP = with_views(TRIPS, PREDICTIONS, _RANKED) + """
SELECT model, round(sum(CAST(pos AS DOUBLE) * (tp + pos) / (tp + pos + fp + neg)) / max(p), 6) AS pr_auc FROM r GROUP BY 1"""


@query("roc_auc_exact", _AUC)
def roc_auc_exact(spark, sf_dir):
    return _round(evaluate.rank_metrics(predictions(spark, sf_dir), ["model"]).select("model", "roc_auc"), "roc_auc")


@query("average_precision_exact", _AP)
def average_precision_exact(spark, sf_dir):
    return _round(evaluate.rank_metrics(predictions(spark, sf_dir), ["model"]).select("model", "pr_auc"), "pr_auc")


@query("average_precision_hot_key_path", _AP)
def average_precision_hot_key_path(spark, sf_dir):
    """The same by the path that large inputs take."""
    out = evaluate.rank_metrics(predictions(spark, sf_dir), ["model"], buckets=16)
    return _round(out.select("model", "pr_auc"), "pr_auc")


@query("curve_points", with_views(TRIPS, PREDICTIONS, _RANKED) + """
SELECT model, score AS threshold, round(CAST(fp + neg AS DOUBLE) / n, 6) AS fpr, round(CAST(tp + pos AS DOUBLE) / p, 6) AS tpr,
       round(CAST(tp + pos AS DOUBLE) / (tp + pos + fp + neg), 6) AS precision FROM r""")
def curve_points(spark, sf_dir):
    return _round(evaluate.curve_points(predictions(spark, sf_dir), ["model"]), "fpr", "tpr", "precision")


@query("threshold_sweep", with_views(TRIPS, PREDICTIONS) + f"""
SELECT model, CAST(t AS DOUBLE) AS threshold, {_prf_sql()} FROM (
  SELECT model, t, {_counts_sql("score >= t")} FROM predictions, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6]) AS t) GROUP BY 1, 2)""")
def threshold_sweep(spark, sf_dir):
    return _round(evaluate.threshold_sweep(predictions(spark, sf_dir), ["model"]), "precision", "recall", "f1")


@query("threshold_curve", with_views(TRIPS, PREDICTIONS) + f"""
SELECT round(t, 2) AS threshold, {_prf_sql()} FROM (
  SELECT t, {_counts_sql("score >= t")} FROM predictions, (SELECT 0.1::DOUBLE + 0.05::DOUBLE * i AS t FROM range(17) s(i)) GROUP BY 1)""")
def threshold_curve(spark, sf_dir):
    out = evaluate.threshold_sweep(predictions(spark, sf_dir), [], evaluate.FINE_THRESHOLDS)
    return _round(_round(out, "precision", "recall", "f1"), "threshold", digits=2)


@query("calibration_bins", with_views(TRIPS, PREDICTIONS) + """
, e AS (SELECT model, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM predictions GROUP BY 1),
b AS (SELECT model, y, score, len(list_filter(edges, lambda x: x < score)) AS bin FROM predictions JOIN e USING (model))
SELECT model, CAST(bin AS INTEGER) AS bin, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed_rate, count(*) AS rows FROM b GROUP BY 1, 2""")
def calibration_bins(spark, sf_dir):
    return _round(evaluate.calibration_table(predictions(spark, sf_dir), ["model"]), "mean_score", "observed_rate")


@query("regression_errors", """
SELECT l_returnflag AS model, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae,
       round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse,
       round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_errors(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred")
    )
    return _round(_round(evaluate.regression_metrics(df, ["model"]), "mae", "rmse", digits=4), "r2")


@query("best_models", with_views(TRIPS, PREDICTIONS) + f""",{_RANKED},
ranked AS (
  SELECT model, sum(CAST(neg AS DOUBLE) * (tp + pos / 2.0)) / (max(p) * max(n)) AS roc_auc,
         sum(CAST(pos AS DOUBLE) * (tp + pos) / (tp + pos + fp + neg)) / max(p) AS pr_auc FROM r GROUP BY 1
),
hits AS (SELECT model, {_prf_sql()} FROM (SELECT model, {_counts_sql("score >= 0.5")} FROM predictions GROUP BY 1)),
best AS (SELECT * FROM ranked JOIN hits USING (model) ORDER BY pr_auc DESC, f1 DESC, recall DESC, model LIMIT 1),
errors AS (
  SELECT l_returnflag AS model, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)) AS rmse,
         1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r2 FROM lineitem GROUP BY 1
),
least AS (SELECT * FROM errors ORDER BY mae, rmse, r2 DESC, model LIMIT 1)
SELECT 'classification' AS task, model, metric, round(value, 4) AS value FROM best UNPIVOT (value FOR metric IN (pr_auc, roc_auc, f1))
UNION ALL
SELECT 'regression', model, metric, round(value, 4) FROM least UNPIVOT (value FOR metric IN (mae, rmse, r2))""")
def best_models(spark, sf_dir):
    """Best classifier and best regressor with their metrics, from tables of predictions."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred")
    )
    classes = evaluate.all_class_metrics(predictions(spark, sf_dir), ["model"])
    return _round(evaluate.best_models(classes, evaluate.regression_metrics(df, ["model"])), "value", digits=4)


@query("confusion", with_views(TRIPS, PREDICTIONS) + """
SELECT model, component, CAST(count AS BIGINT) AS count FROM (
  SELECT model, count(*) FILTER (y = 0 AND pred = 0) AS TN, count(*) FILTER (y = 0 AND pred = 1) AS FP,
         count(*) FILTER (y = 1 AND pred = 0) AS FN, count(*) FILTER (y = 1 AND pred = 1) AS TP FROM predictions GROUP BY 1)
UNPIVOT (count FOR component IN (TN, FP, FN, TP))""")
def confusion(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir), ["model"])


@query("valid_predictions", with_views(TRIPS, PREDICTIONS) + f"""
SELECT model, tp + fp + fn + tn AS evaluation_rows_valid, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, {_prf_sql()},
       round(CAST(tp + fp + fn + tn AS DOUBLE) / n, 6) AS valid_prediction_rate
FROM (SELECT model, count(*) AS n, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
             count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM predictions GROUP BY 1)""")
def valid_predictions(spark, sf_dir):
    out = evaluate.valid_prediction_metrics(predictions(spark, sf_dir), ["model"])
    return _round(out, "accuracy", "precision", "recall", "f1", "valid_prediction_rate")


# daily rates per carrier as a metric table
FOLDS = """
folds AS (SELECT carrier AS model, trip_date AS fold, avg(delayed) AS f1 FROM trips GROUP BY 1, 2),
s AS (SELECT model, count(*) AS n, avg(f1) AS mean, var_samp(f1) AS var FROM folds GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS total, sum(n * mean) AS s1, sum(n * mean * mean) AS s2, sum((n - 1) * var) AS within FROM s)"""


def _folds(spark, sf_dir):
    return trips(spark, sf_dir).groupBy(F.col("carrier").alias("model"), F.col("trip_date").alias("fold")).agg(F.avg("delayed").alias("f1"))


@query("anova_f", with_views(TRIPS, FOLDS) + """
SELECT k - 1 AS df1, CAST(total - k AS BIGINT) AS df2, round((s2 - s1 * s1 / total) / (k - 1) / (within / (total - k)), 5) AS f_statistic FROM a""")
def anova_f(spark, sf_dir):
    out = stats.anova_oneway(_folds(spark, sf_dir), "model", "f1")
    return _round(out.select("df1", F.col("df2").cast("bigint").alias("df2"), "f_statistic"), "f_statistic", digits=5)


@query("pairwise_diff", with_views(TRIPS, FOLDS) + """
SELECT x.model AS group1, y.model AS group2, round(y.mean - x.mean, 6) AS meandiff,
       round(abs(y.mean - x.mean) / sqrt(within / (total - k) / 2 * (1.0 / x.n + 1.0 / y.n)), 5) AS q_statistic
FROM s x JOIN s y ON x.model < y.model CROSS JOIN a""")
def pairwise_diff(spark, sf_dir):
    out = stats.pairwise_mean_diff(_folds(spark, sf_dir), "model", "f1")
    return _round(_round(out, "meandiff"), "q_statistic", digits=5)


_ROUNDS = 199


def _mixed_sql(x: str) -> str:
    """One mixing of a number x below n (bits, mask and half follow from n) with the keys of the round."""
    for j, multiplier in enumerate(stats.MULTIPLIERS):
        key = f"CAST('0x' || substr(md5('{stats.SEED}|' || round || '|{j}'), 1, 8) AS BIGINT) >> 1"
        x = f"list_transform([xor({x}, ({key}) & mask) * (({multiplier} & mask) | 1) & mask], lambda v: xor(v, v >> half))[1]"
    return x


_PERMUTED = f"""
numbered AS (SELECT row_number() OVER (ORDER BY fold, model) - 1 AS position, model, f1 FROM folds),
sizes AS (SELECT count(*) AS n, greatest(1, ceil(log2(count(*)))::BIGINT) AS bits FROM numbered),
masks AS (SELECT n, (1 << bits) - 1 AS mask, greatest(1, bits // 2)::BIGINT AS half FROM sizes),
dealt AS (
  SELECT round, f1, list_reduce(list_prepend(CAST(position AS BIGINT), range({stats.WALK + 1})),
           lambda x, t: CASE WHEN t > 0 AND x < n THEN x ELSE {_mixed_sql("x")} END) AS place
  FROM numbered, masks, (SELECT unnest(range(1, {_ROUNDS + 1})) AS round)
),
shuffled AS (SELECT round, model, dealt.f1 FROM dealt JOIN numbered ON place = position),
rs AS (SELECT round, model, count(*) AS n, avg(f1) AS mean, coalesce(var_samp(f1), 0) AS var FROM shuffled GROUP BY 1, 2),
ra AS (SELECT round, count(*) AS k, sum(n) AS total, sum(n * mean) AS s1, sum(n * mean * mean) AS s2, sum((n - 1) * var) AS within FROM rs GROUP BY 1),
rf AS (SELECT round, within / (total - k) AS mse, (s2 - s1 * s1 / total) / (k - 1) / (within / (total - k)) AS f FROM ra),
rq AS (SELECT round, max(abs(y.mean - x.mean) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n))) AS q
       FROM rs x JOIN rs y USING (round) JOIN rf USING (round) WHERE x.model < y.model GROUP BY 1)"""


@query("significance_table", with_views(TRIPS, FOLDS, _PERMUTED) + f"""
, p AS (SELECT x.model AS group1, y.model AS group2, y.mean - x.mean AS meandiff,
               abs(y.mean - x.mean) / sqrt(within / (total - k) / 2 * (1.0 / x.n + 1.0 / y.n)) AS q
        FROM s x JOIN s y ON x.model < y.model CROSS JOIN a),
c AS (SELECT p.*, ((SELECT count(*) FROM rq WHERE rq.q >= p.q - 1e-12) + 1) / {_ROUNDS + 1}.0 AS p_adj FROM p)
SELECT group1, group2, round(meandiff, 6) AS meandiff, round(q, 5) AS q_statistic, round(CAST(p_adj AS DOUBLE), 6) AS p_adj, p_adj < 0.05 AS reject FROM c""")
def significance_table(spark, sf_dir):
    """Pairwise table with permutation p-values."""
    _, pairs = stats.significance(_folds(spark, sf_dir), "model", "f1", ["fold", "model"], rounds=_ROUNDS)
    return _round(_round(pairs, "meandiff", "p_adj"), "q_statistic", digits=5)


@query("anova_p_value", with_views(TRIPS, FOLDS, _PERMUTED) + f"""
SELECT k - 1 AS df1, CAST(total - k AS BIGINT) AS df2, round(f, 5) AS f_statistic, round(CAST(((SELECT count(*) FROM rf WHERE rf.f >= o.f - 1e-12) + 1) / {_ROUNDS + 1}.0 AS DOUBLE), 6) AS p_value
FROM (SELECT *, (s2 - s1 * s1 / total) / (k - 1) / (within / (total - k)) AS f FROM a) o""")
def anova_p_value(spark, sf_dir):
    """The F test with its permutation p-value."""
    test, _ = stats.significance(_folds(spark, sf_dir), "model", "f1", ["fold", "model"], rounds=_ROUNDS)
    return _round(_round(test.select("df1", F.col("df2").cast("bigint").alias("df2"), "f_statistic", "p_value"), "p_value"), "f_statistic", digits=5)


# --- preparation ---------------------------------------------------------------------------
@query("impute_median_mode", with_views(TRIPS) + """
SELECT 'dep_delay' AS feature, CAST(round(median(dep_delay), 6) AS VARCHAR) AS fill FROM trips
UNION ALL SELECT 'distance', CAST(round(median(distance), 6) AS VARCHAR) FROM trips
UNION ALL SELECT 'tail', (SELECT tail FROM trips WHERE tail IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tail LIMIT 1)
UNION ALL SELECT 'origin', (SELECT origin FROM trips GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 1)""")
def impute_median_mode(spark, sf_dir):
    t = trips(spark, sf_dir)
    medians = prep.column_medians(t, ["dep_delay", "distance"]).select("feature", F.round("median", 6).cast("string").alias("fill"))
    modes = prep.column_modes(t, ["tail", "origin"]).select("feature", F.col("mode").alias("fill"))
    return medians.unionByName(modes)


@query("ordinal_codes", with_views(TRIPS) + """
, d AS (SELECT tail, dense_rank() OVER (ORDER BY tail) - 1 AS code FROM (SELECT DISTINCT tail FROM trips WHERE trip_date < DATE '2024-01-03' AND tail IS NOT NULL))
SELECT trip_id, coalesce(code, -1) AS code FROM trips LEFT JOIN d USING (tail)""")
def ordinal_codes(spark, sf_dir):
    t = trips(spark, sf_dir)
    dictionary = prep.ordinal_dictionary(t.where("trip_date < '2024-01-03'"), "tail")
    return prep.ordinal_encode(t, dictionary, "tail", "code").select("trip_id", "code")


@query("one_hot_codes", with_views(TRIPS) + """
, k AS (SELECT DISTINCT origin FROM trips WHERE hour(dep_ts) < 2 AND trip_date = DATE '2024-01-01')
SELECT origin, count(*) AS rows, CASE WHEN origin IN (SELECT origin FROM k) THEN 1 ELSE 0 END AS known FROM trips GROUP BY 1""")
def one_hot_codes(spark, sf_dir):
    """Categories fitted on a few rows; unseen ones give a vector of zeros."""
    from pyspark.ml.functions import vector_to_array

    t = trips(spark, sf_dir)
    fitted = prep.fit_prep(t.where("trip_date = '2024-01-01' AND hour(dep_ts) < 2"), ["origin"], [], "onehot")
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)
    return fitted.transform(t).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.max(ones).cast("int").alias("known"))


@query("standardized", """
SELECT l_returnflag, round(avg((l_quantity - m) / s), 6) AS quantity, round(min((l_extendedprice - mp) / sp), 6) AS price, round(max((l_extendedprice - mp) / sp), 6) AS top
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem) GROUP BY 1""")
def standardized(spark, sf_dir):
    df = prep.standardize(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    out = df.groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("price"), F.max("l_extendedprice").alias("top")
    )
    return _round(out, "quantity", "price", "top")


@query("class_weights", """
SELECT quality, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY 1""")
def class_weights(spark, sf_dir):
    return _round(prep.class_weights(table(spark, sf_dir, "labels"), "quality"), "weight")


_F_ROWS = """
x AS (SELECT delayed AS y, 'distance' AS feature, CAST(distance AS DOUBLE) AS v FROM trips
      UNION ALL SELECT delayed, 'hour', CAST(hour(dep_ts) AS DOUBLE) FROM trips
      UNION ALL SELECT delayed, 'dep_delay', dep_delay FROM trips WHERE dep_delay IS NOT NULL),
c AS (SELECT feature, y, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM x GROUP BY 1, 2)"""


@query("f_score", with_views(TRIPS, _F_ROWS) + """
SELECT feature, round((sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n)) / (count(*) - 1) / (sum(n * var) / (sum(n) - count(*))), 3) AS f_score
FROM c GROUP BY 1""")
def f_score(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("hour", F.hour("dep_ts"))
    return _round(prep.f_scores(t, ["distance", "hour", "dep_delay"], "delayed"), "f_score", digits=3)


@query("binned_mi", with_views(TRIPS) + """
, e AS (SELECT quantile_cont(distance, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS de, quantile_cont(dep_delay, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ee FROM trips),
b AS (SELECT delayed AS y, 'distance' AS feature, CAST(len(list_filter(de, lambda x: x < distance)) AS VARCHAR) AS bin FROM trips, e
      UNION ALL SELECT delayed, 'dep_delay', CASE WHEN dep_delay IS NOT NULL THEN CAST(len(list_filter(ee, lambda x: x < dep_delay)) AS VARCHAR) END FROM trips, e
      UNION ALL SELECT delayed, 'origin', origin FROM trips),
c AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, round(greatest(sum(n / total * ln(n * total / (CAST(nb AS DOUBLE) * ny))), 0), 6) AS mutual_information FROM m GROUP BY 1""")
def binned_mi(spark, sf_dir):
    out = prep.binned_mutual_information(trips(spark, sf_dir), ["distance", "dep_delay"], ["origin"], "delayed")
    return _round(out, "mutual_information")


_DIGAMMA = (
    "(ln({x} + 6.0) - 0.5 / ({x} + 6.0) - 1.0 / (12 * ({x} + 6.0) ** 2) + 1.0 / (120 * ({x} + 6.0) ** 4) - 1.0 / (252 * ({x} + 6.0) ** 6)"
    " + 1.0 / (240 * ({x} + 6.0) ** 8) - 1.0 / (132 * ({x} + 6.0) ** 10) - 1.0 / {x} - 1.0 / ({x} + 1) - 1.0 / ({x} + 2) - 1.0 / ({x} + 3)"
    " - 1.0 / ({x} + 4) - 1.0 / ({x} + 5))"
)


def _neighbour_mi_sql() -> str:
    reach = lambda size: "least(" + ", ".join(
        f"greatest(v - {'v' if j == 0 else f'coalesce(lag(v, {j}) OVER w, -1e308)'}, {'v' if j == size else f'coalesce(lead(v, {size - j}) OVER w, 1e308)'} - v)"
        for j in range(size + 1)
    ) + ")"
    psi = lambda x: _DIGAMMA.format(x=x)
    return f"""
, x AS (SELECT delayed AS y, 'distance' AS feature, CAST(distance AS DOUBLE) AS v FROM trips
        UNION ALL SELECT delayed, 'dep_delay', dep_delay FROM trips
        UNION ALL SELECT delayed, 'hour', CAST(hour(dep_ts) AS DOUBLE) FROM trips
        UNION ALL SELECT CAST(substr(origin, 2) AS INTEGER), 'by_origin', dep_delay FROM trips),
c AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size FROM x WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY feature, y) > 1),
d AS (SELECT feature, y, v, size, least(3, size - 1) AS k,
             CASE least(3, size - 1) WHEN 1 THEN {reach(1)} WHEN 2 THEN {reach(2)} ELSE {reach(3)} END AS r
      FROM c WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
q AS (SELECT feature, y, v, any_value(size) AS size, CASE WHEN min(r) = 0 THEN count(*) - 1 ELSE any_value(k) END AS k, min(r) AS r, count(*) AS n
      FROM d GROUP BY 1, 2, 3),
h AS (SELECT feature, v, count(*) AS n FROM c GROUP BY 1, 2),
m AS (SELECT q.feature, q.y, q.v, q.size, q.k, q.n, sum(h.n) AS m FROM q JOIN h ON h.feature = q.feature
        AND ((q.r > 0 AND h.v < q.v + q.r AND h.v > q.v - q.r) OR (q.r = 0 AND h.v = q.v)) GROUP BY ALL)
SELECT feature, round(greatest(max({psi("t")}) + sum(n * ({psi("k")} - {psi("size")} - {psi("m")})) / max(t), 0), 6) AS mutual_information
FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t FROM m) GROUP BY 1"""


@query("neighbour_mi", with_views(TRIPS) + _neighbour_mi_sql())
def neighbour_mi(spark, sf_dir):
    """The estimate from neighbours: two classes, and thirty classes of a continuous value."""
    t = trips(spark, sf_dir).withColumns({"hour": F.hour("dep_ts"), "place": F.substring("origin", 2, 9).cast("int")})
    out = information.neighbour_mutual_information(t, ["distance", "dep_delay", "hour"], "delayed")
    many = information.neighbour_mutual_information(t.withColumn("by_origin", F.col("dep_delay")), ["by_origin"], "place", buckets=12)
    return _round(out.unionByName(many), "mutual_information")


@query("log1p_selection", """
WITH s AS (SELECT 'l_extendedprice' AS feature, min(l_extendedprice) AS low, skewness(l_extendedprice) AS skew FROM lineitem
  UNION ALL SELECT 'rare', min(v), skewness(v) FROM (SELECT CASE WHEN l_quantity > 48 AND l_linenumber = 1 THEN 1.0 ELSE 0.0 END AS v FROM lineitem)
  UNION ALL SELECT 'shifted', min(v), skewness(v) FROM (SELECT CASE WHEN l_quantity > 48 AND l_linenumber = 1 THEN 1.0 ELSE 0.0 END - 1 AS v FROM lineitem))
SELECT feature, low, round(skew, 6) AS skew, CASE WHEN low >= 0 AND skew >= 1.5 THEN 1 ELSE 0 END AS selected FROM s""")
def log1p_selection(spark, sf_dir):
    rare = F.when((F.col("l_quantity") > 48) & (F.col("l_linenumber") == 1), 1.0).otherwise(0.0)
    li = table(spark, sf_dir, "lineitem").withColumns({"rare": rare, "shifted": rare - 1})
    return _round(features.log_candidates(li, ["l_extendedprice", "rare", "shifted"]), "skew")


@query("log1p_twins", """
WITH s AS (SELECT CASE WHEN l_quantity > 48 AND l_linenumber = 1 THEN 7.0 ELSE 0.0 END AS v, l_returnflag,
                  CAST(l_shipdate AS DATE) < DATE '1999-01-01' AS is_train FROM lineitem)
SELECT is_train, l_returnflag, round(avg(ln(1 + v)), 6) AS twin, count(*) AS rows FROM s GROUP BY 1, 2""")
def log1p_twins(spark, sf_dir):
    spiky = F.when((F.col("l_quantity") > 48) & (F.col("l_linenumber") == 1), 7.0).otherwise(0.0)
    li = table(spark, sf_dir, "lineitem").withColumns({"spiky": spiky, "is_train": F.to_date("l_shipdate") < F.lit("1999-01-01").cast("date")})
    train, test, _ = features.log1p_if_skewed(li.where("is_train"), li.where("NOT is_train"), ["spiky", "l_quantity"])
    both = train.unionByName(test)
    return _round(both.groupBy("is_train", "l_returnflag").agg(F.avg("log1p_spiky").alias("twin"), F.count(F.lit(1)).alias("rows")), "twin")


# --- prompts -----------------------------------------------------------------------------------
@query("prompt_texts", with_views(TRIPS) + f"""
, rows AS (SELECT trip_id, delayed, {_ROW_SQL} AS text FROM trips),
shots AS (SELECT string_agg('Example: ' || text || ' -> ' || CASE WHEN delayed = 1 THEN 'DELAY' ELSE 'ON_TIME' END, chr(10) ORDER BY trip_id) AS shots
          FROM (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY delayed ORDER BY trip_id) <= 4))
SELECT trip_id, 'Predict whether the flight will be delayed by 15+ minutes.' || chr(10) || 'Use only the provided row features.' || chr(10)
       || 'Respond with exactly one label: DELAY or ON_TIME.' || chr(10) || shots || chr(10) || 'Target row: ' || text || chr(10) || 'Prediction:' AS prompt
FROM rows, shots""")
def prompt_texts(spark, sf_dir):
    """A prompt for every row, with the first four rows of each label as examples."""
    rows = prompt_frame(spark, sf_dir)
    first = [rows.where(F.col("delayed") == v).orderBy("trip_id").limit(4) for v in (0, 1)]
    return prompts.build_prompts(rows, first[0].unionByName(first[1]), "delayed", ["trip_id"]).select("trip_id", "prompt")


_MIX = "CAST('0x' || substr(md5('{seed}|' || coalesce(CAST({id} AS VARCHAR), '')), 1, 15) AS BIGINT)"


@query("balanced_prompt_sample", with_views(TRIPS) + f"""
, days AS (SELECT trip_date, row_number() OVER (ORDER BY trip_date) - 1 AS position, count(*) OVER () AS n
           FROM (SELECT DISTINCT trip_date FROM trips WHERE trip_date IS NOT NULL)),
cut AS (SELECT min(trip_date) AS cut FROM days WHERE position >= greatest(floor(n * 0.8), 1)),
marked AS (SELECT *, CASE WHEN trip_date < cut THEN 'train' ELSE 'test' END AS role FROM trips, cut WHERE trip_date IS NOT NULL),
ranked AS (SELECT role, trip_id, delayed, CASE WHEN role = 'train' THEN 8 ELSE 80 END AS size,
             row_number() OVER (PARTITION BY role, delayed ORDER BY {_MIX.format(seed=42, id="trip_id")}, trip_id) AS place FROM marked),
positives AS (SELECT * FROM ranked WHERE delayed = 1 AND place <= size // 2),
found AS (SELECT role, count(*) AS n FROM positives GROUP BY 1)
SELECT role, trip_id, delayed FROM positives
UNION ALL SELECT r.role, trip_id, delayed FROM ranked r LEFT JOIN found f ON f.role = r.role
WHERE delayed = 0 AND place <= size - coalesce(f.n, 0)""")
def balanced_prompt_sample(spark, sf_dir):
    marked = split.with_split_role(trips(spark, sf_dir), "trip_date")
    train = split.balanced_sample(marked.where("role = 'train'"), "delayed", 8, ["trip_id"])
    test = split.balanced_sample(marked.where("role = 'test'"), "delayed", 80, ["trip_id"])
    return train.unionByName(test).select("role", "trip_id", "delayed")


# --- models ------------------------------------------------------------------------------------
CATEGORICAL, NUMERIC = ["carrier", "origin"], ["distance", "hour", "weekday", "prev_delay", "prev_rate"]


def model_rows(spark, sf_dir):
    """Trips with features of their past, split by date."""
    from punctual.operators.history import previous_period_features

    t = previous_period_features(trips(spark, sf_dir), "dep_ts", "dep_delay", "delayed", {"origin": "origin"}, rolling=("origin",))
    t = t.select(
        "trip_id", "trip_date", "carrier", "origin", "delayed", "dep_delay", "distance", F.hour("dep_ts").alias("hour"),
        (F.weekday("trip_date") + 1).alias("weekday"), F.col("origin_avg_dep_delay_prev_hour").alias("prev_delay"),
        F.col("origin_delay_rate_prev_3h").alias("prev_rate"),
        F.greatest(F.coalesce("dep_delay", F.lit(0.0)), F.lit(0.0)).alias("late_minutes"),
    )
    # as many files as cores: every model reads the table again
    t = features.staged(spread(t, table(spark, sf_dir, "events").count()))
    return split.temporal_split(t, "trip_date")


@query("majority_scores", with_views(TRIPS) + """
, m AS (SELECT delayed AS label FROM trips GROUP BY 1 ORDER BY count(*) DESC, delayed LIMIT 1)
SELECT delayed AS y, CAST(label AS DOUBLE) AS score, count(*) AS rows FROM trips, m GROUP BY 1, 2""")
def majority_scores(spark, sf_dir):
    t = trips(spark, sf_dir)
    fitted = models.fit_classifier("dummy_most_frequent", t, [], [], "delayed")
    return fitted.score(t, "delayed", ["trip_id"]).groupBy("y", "score").agg(F.count(F.lit(1)).alias("rows"))


@query("linear_fit", """
SELECT round(regr_slope(l_extendedprice, l_quantity) * 3 + regr_intercept(l_extendedprice, l_quantity), 2) AS at_3,
       round(regr_slope(l_extendedprice, l_quantity) * 40 + regr_intercept(l_extendedprice, l_quantity), 2) AS at_40 FROM lineitem""")
def linear_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    fitted = models.fit_regressor("linear_regression", li, [], ["l_quantity"], "l_extendedprice")
    out = fitted.predict(li.select("l_quantity", "l_extendedprice"), "l_extendedprice", ["l_quantity"])
    at = lambda q: F.round(F.max(F.when(F.col("l_quantity") == q, F.col("pred"))), 2)
    return out.agg(at(3).alias("at_3"), at(40).alias("at_40"))


@query("model_grid")
def model_grid(spark, sf_dir):
    """Four classifier families on a temporal split, compared."""
    train, test, _ = model_rows(spark, sf_dir)
    return models.run_classification(train, test, CATEGORICAL, NUMERIC, "delayed", ["trip_id"]).metrics


@query("fold_grid")
def fold_grid(spark, sf_dir):
    """All four families on four expanding folds."""
    train, test, _ = model_rows(spark, sf_dir)
    return models.run_fold_grid(train.unionByName(test), "trip_date", 4, CATEGORICAL, NUMERIC, "delayed", ["trip_id"])


@query("regression_grid")
def regression_grid(spark, sf_dir):
    train, test, _ = model_rows(spark, sf_dir)
    metrics, _ = models.run_regression(train, test, CATEGORICAL, NUMERIC, "late_minutes", ["trip_id"])
    return metrics


@query("imbalance_grid")
def imbalance_grid(spark, sf_dir):
    train, test, _ = model_rows(spark, sf_dir)
    grow = lambda df: smote.smote_nc(df, [f"__n_{c}" for c in NUMERIC], [f"__o_{c}" for c in CATEGORICAL], "delayed", ["trip_id"])
    return models.run_imbalance(train, test, CATEGORICAL, NUMERIC, "delayed", ["trip_id"], grow)


@query("pca_comparison")
def pca_comparison(spark, sf_dir):
    train, test, _ = model_rows(spark, sf_dir)
    return models.run_pca_comparison(train, test, CATEGORICAL, NUMERIC, "delayed", ["trip_id"])


@query("smote_nc", with_views(TRIPS) + """
SELECT delayed, max(n) OVER () AS rows FROM (SELECT delayed, count(*) AS n FROM trips GROUP BY 1)""")
def smote_nc(spark, sf_dir):
    """Class sizes after oversampling are equal."""
    t = trips(spark, sf_dir).withColumns({"hour": F.hour("dep_ts").cast("double"), "distance": F.col("distance").cast("double")})
    grown = smote.smote_nc(t, ["distance", "hour"], ["carrier", "origin"], "delayed", ["trip_id"])
    return grown.groupBy("delayed").agg(F.count(F.lit(1)).alias("rows"))


_DRAW = "CAST('0x' || substr(md5('{kind}|{seed}|' || {parts}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


def _draw_sql(kind: str, parts: str) -> str:
    return _DRAW.format(kind=kind, seed=smote.SEED, parts=parts)


_NEAR = """
sized AS (SELECT delayed, count(*) AS n FROM trips GROUP BY 1),
small AS (SELECT delayed AS minority, n AS size, (SELECT max(n) FROM sized) - n AS wanted FROM sized ORDER BY n, delayed LIMIT 1),
minor AS (SELECT trip_id, CAST(distance AS DOUBLE) AS distance, CAST(hour(dep_ts) AS DOUBLE) AS hour, carrier, origin FROM trips, small WHERE delayed = minority),
penalty AS (SELECT (stddev_samp(distance) + stddev_samp(hour)) / 2 AS p FROM minor),
near AS (
  SELECT a.trip_id, b.trip_id AS neighbour,
         (a.distance - b.distance) * (a.distance - b.distance) + (a.hour - b.hour) * (a.hour - b.hour)
           + CASE WHEN a.carrier <> b.carrier THEN p * p ELSE 0 END + CASE WHEN a.origin <> b.origin THEN p * p ELSE 0 END AS square
  FROM minor a JOIN minor b ON a.trip_id <> b.trip_id, penalty
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY square, neighbour) AS rank FROM near QUALIFY rank <= 5)"""


def _oversampled(spark, sf_dir):
    return trips(spark, sf_dir).withColumns({"hour": F.hour("dep_ts").cast("double"), "distance": F.col("distance").cast("double")})


@query("smote_neighbours", with_views(TRIPS, _NEAR) + """
SELECT trip_id, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(square), 6) AS distance FROM ranked""")
def smote_neighbours(spark, sf_dir):
    """The five nearest other rows of every row of the minority class."""
    t = _oversampled(spark, sf_dir)
    sizes = {r["delayed"]: r["count"] for r in t.groupBy("delayed").count().collect()}
    minor = t.where(F.col("delayed") == min(sizes, key=lambda c: (sizes[c], c)))
    penalty = minor.agg((F.stddev_samp("distance") + F.stddev_samp("hour")) / 2).first()[0]
    return _round(nearest.nearest_rows(minor, "trip_id", ["distance", "hour"], ["carrier", "origin"], penalty), "distance")


@query("smote_rows", with_views(TRIPS, _NEAR) + f"""
, starts AS (SELECT trip_id, minor.distance, minor.hour, row_number() OVER (ORDER BY {_draw_sql("order", "trip_id")}, trip_id) - 1 AS place FROM minor),
copies AS (SELECT trip_id, starts.distance, starts.hour, unnest(range(1, wanted // size + CASE WHEN place < wanted % size THEN 1 ELSE 0 END + 1)) AS copy FROM starts, small),
drawn AS (SELECT *, CAST(floor({_draw_sql("neighbour", "trip_id || '|' || copy")} * (SELECT least(5, size - 1) FROM small)) AS BIGINT) + 1 AS rank,
                 {_draw_sql("gap", "trip_id || '|' || copy")} AS gap FROM copies),
carriers AS (SELECT r.trip_id, m.carrier FROM ranked r JOIN minor m ON m.trip_id = neighbour GROUP BY 1, 2
             QUALIFY row_number() OVER (PARTITION BY r.trip_id ORDER BY count(*) DESC, m.carrier) = 1),
origins AS (SELECT r.trip_id, m.origin FROM ranked r JOIN minor m ON m.trip_id = neighbour GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY r.trip_id ORDER BY count(*) DESC, m.origin) = 1)
SELECT round(CAST(distance AS DOUBLE), 6) AS distance, CAST(hour(dep_ts) AS DOUBLE) AS hour, carrier, origin, delayed FROM trips
UNION ALL
SELECT round(d.distance + gap * (m.distance - d.distance), 6), round(d.hour + gap * (m.hour - d.hour), 6), c.carrier, o.origin, minority
FROM drawn d JOIN ranked r ON r.trip_id = d.trip_id AND r.rank = d.rank JOIN minor m ON m.trip_id = r.neighbour
JOIN carriers c ON c.trip_id = d.trip_id JOIN origins o ON o.trip_id = d.trip_id, small""")
def smote_rows(spark, sf_dir):
    """All rows of the oversampled table, the given ones and the synthetic ones."""
    grown = smote.smote_nc(_oversampled(spark, sf_dir), ["distance", "hour"], ["carrier", "origin"], "delayed", ["trip_id"])
    return _round(grown, "distance", "hour")


@query("kmeans_profiles")
def kmeans_profiles(spark, sf_dir):
    profile = entity_profile(trips(spark, sf_dir), "origin", "delayed", {"avg_delay": "dep_delay", "avg_distance": "distance"})
    names = ["delay_rate", "avg_delay", "avg_distance"]
    return models.project_2d(models.cluster_profiles(profile, names), names)


def _embedding_columns(spark, sf_dir, size=64):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(size)]), [f"e{i}" for i in range(size)]


@query("pca_variance")
def pca_variance(spark, sf_dir):
    e, names = _embedding_columns(spark, sf_dir)
    return prep.pca_report(e, names)[0]


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    e, names = _embedding_columns(spark, sf_dir)
    return prep.pca_report(e, names)[1]


@query("feature_ranking")
def feature_ranking(spark, sf_dir):
    train, _, _ = model_rows(spark, sf_dir)
    return prep.feature_ranking(train.dropna(subset=["dep_delay"]), CATEGORICAL, NUMERIC, "delayed", "dep_delay")


@query("tree_importance")
def tree_importance(spark, sf_dir):
    train, _, _ = model_rows(spark, sf_dir)
    fitted = models.fit_classifier("random_forest_balanced", train, CATEGORICAL, NUMERIC, "delayed")
    return importance.model_importance(spark, fitted)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    train, test, _ = model_rows(spark, sf_dir)
    fitted = models.fit_classifier("logistic_regression_balanced", train, CATEGORICAL, NUMERIC, "delayed")
    return importance.permutation_importance(fitted, test, ["trip_id"])

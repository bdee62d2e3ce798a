"""Metrics from a predictions table: ``keys.., y, score`` (``pred`` for given labels).

Rank metrics need the scores in order.  Equal scores collapse to one row with their counts
first; the running counts over the ordered scores come from ``OrderedScan``, so neither a
single model with all rows nor a crowded score range ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.quantile import exact_quantiles
from punctual.operators.scan import OrderedScan
from punctual.session import staged


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _counts(y: Column, pred: Column) -> dict[str, Column]:
    return {
        "tn": F.count_if((y == 0) & (pred == 0)), "fp": F.count_if((y == 0) & (pred == 1)),
        "fn": F.count_if((y == 1) & (pred == 0)), "tp": F.count_if((y == 1) & (pred == 1)),
    }


def class_metrics(df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at a threshold (scores at it count as positive)."""
    hit = (F.col("score") >= threshold).cast("int")
    counted = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(F.col("y"), hit).items()])
    return counted.select(*keys, *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def ranked_scores(df: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """One row per distinct score with its class counts and those of all higher scores."""
    keys = list(keys)
    groups = df.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    groups = staged(groups.withColumn("__down", -F.col("score")))
    scan = OrderedScan(groups, keys, ["__down"], buckets).prior_sums({"tp": F.col("pos"), "fp": F.col("neg")})
    zero = F.lit(0).cast("bigint")
    return scan.result().withColumns({"tp": F.coalesce("tp", zero), "fp": F.coalesce("fp", zero)}).drop("__down")


def rank_metrics(df: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) per key.

    ROC-AUC is null where a class is absent; average precision is then 0 without positives.
    """
    r = ranked_scores(df, keys, buckets)
    reached = F.col("tp") + F.col("pos")
    wins = F.sum(F.col("neg") * (F.col("tp") + F.col("pos") / 2))
    steps = F.sum(F.col("pos") * reached / (reached + F.col("fp") + F.col("neg")))
    agg = r.groupBy(*keys).agg(
        wins.alias("wins"), steps.alias("steps"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return agg.select(
        *keys,
        F.when(both, F.col("wins") / (F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        ratio(F.col("steps"), F.col("p")).alias("pr_auc"),
    )


def curve_points(df: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    keys = list(keys)
    r = ranked_scores(df, keys, buckets)
    totals = df.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("__p"), F.count_if(F.col("y") == 0).alias("__n"))
    if keys:
        r = r.join(totals, keys)
    else:
        r = r.withColumns({c: totals.select(c).scalar() for c in ("__p", "__n")})
    tp, fp = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    return r.select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(fp, F.col("__n")).alias("fpr"),
        ratio(tp, F.col("__p")).alias("tpr"),
        ratio(tp, tp + fp).alias("precision"),
    )


# fixed values: thresholds of the model table and of the trade-off curve
THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6]
FINE_THRESHOLDS = [0.1 + 0.05 * i for i in range(17)]


def threshold_sweep(df: DataFrame, keys: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 at each threshold; one pass, whatever the number of thresholds."""
    aggregates = []
    for i, t in enumerate(thresholds):
        counted = _counts(F.col("y"), (F.col("score") >= t).cast("int"))
        aggregates.append(F.struct(F.lit(float(t)).alias("threshold"), *[counted[c].alias(c) for c in ("tp", "fp", "fn")]).alias(f"t{i}"))
    wide = df.groupBy(*keys).agg(*aggregates)
    long = wide.select(*keys, F.inline(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])))
    return long.select(*keys, "threshold", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def calibration_table(df: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin of the score; empty bins have no row."""
    keys = list(keys)
    inner = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, ["score"], inner, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list("quantile")).alias("__edges")  # bins - 1 numbers
    )
    if keys:
        placed = df.join(edges, keys)
    else:
        placed = df.withColumn("__edges", edges.scalar())
    score = F.col("score")
    placed = placed.withColumn("bin", F.size(F.filter("__edges", lambda e: e < score)))
    return placed.groupBy(*keys, "bin").agg(
        F.avg("score").alias("mean_score"), F.avg("y").alias("observed_rate"), F.count(F.lit(1)).alias("rows")
    )


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, RMSE and R2 per key."""
    error = F.col(y) - F.col(pred)
    agg = df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("var")
    )
    r2 = F.when(F.col("var") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("mse") / F.col("var"))
    return agg.select(*keys, "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """(component, count) per key over rows with a prediction."""
    counted = df.where(F.col(pred).isNotNull()).groupBy(*keys).agg(
        *[c.alias(n.upper()) for n, c in _counts(F.col("y"), F.col(pred)).items()]
    )
    return counted.unpivot(list(keys), ["TN", "FP", "FN", "TP"], "component", "count")


def valid_prediction_metrics(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1 over rows with a prediction, and their share."""
    valid = F.col(pred).isNotNull()
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("valid"),
        *[c.alias(n) for n, c in _counts(F.col("y"), F.col(pred)).items()],
    )
    known = lambda c: F.when(F.col("valid") > 0, c)
    prf = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select(
        *keys,
        F.col("valid").alias("evaluation_rows_valid"),
        known((F.col("tp") + F.col("tn")) / F.col("valid")).alias("accuracy"),
        *[known(c).alias(n) for c, n in zip(prf, ("precision", "recall", "f1"))],
        ratio(F.col("valid"), F.col("rows")).alias("valid_prediction_rate"),
    )


def best_models(classes: DataFrame, regressions: DataFrame) -> DataFrame:
    """Rows (task, model, metric, value) of the best classifier and of the best regressor.

    Classifiers stand by average precision, F1, recall; regressors by mean and root mean square
    error and by R2; ties go to the smaller name.
    """
    first = classes.orderBy(F.desc("pr_auc"), F.desc("f1"), F.desc("recall"), "model").limit(1)
    second = regressions.orderBy("mae", "rmse", F.desc("r2"), "model").limit(1)

    def rows(df: DataFrame, task: str, names: Sequence[str]) -> DataFrame:
        named = df.select(F.lit(task).alias("task"), "model", *names)
        return named.unpivot(["task", "model"], list(names), "metric", "value")

    return rows(first, "classification", ["pr_auc", "roc_auc", "f1"]).unionByName(rows(second, "regression", ["mae", "rmse", "r2"]))


def all_class_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold and rank metrics side by side, best first."""
    return class_metrics(df, keys).join(rank_metrics(df, keys), list(keys)).orderBy(
        F.desc("pr_auc"), F.desc("f1"), F.desc("recall"), *keys
    )

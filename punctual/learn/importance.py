"""What a trained model relies on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.learn.models import Fitted
from punctual.operators.scan import OrderedScan
from punctual.operators.split import SEED, sample_cap


def model_importance(spark, fitted: Fitted, top: int = 15) -> DataFrame:
    """(feature, importance): tree importances or absolute coefficients, largest first."""
    model = fitted.model
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(fitted.prep.names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(
    fitted: Fitted, test: DataFrame, identity: Sequence[str], sample: int | None = None, top: int = 20, seed: int = SEED
) -> DataFrame:
    """(feature, mean_abs_change): how far the score moves when a feature is taken from another row.

    The other row is the one before in a hashed order, so one ordered scan serves all features.
    All rows are scored once per feature, or ``sample`` of them if it is given.
    """
    features = [*fitted.prep.categorical, *fitted.prep.numeric]
    rows = test.select(*identity, *[c for c in features if c not in set(identity)])
    if sample is not None:
        rows = sample_cap(rows, sample, identity, seed)
    rows = rows.withColumn("__mix", F.xxhash64(F.lit(seed + 1), *identity))
    donor = {f"__d{i}": F.col(c) for i, c in enumerate(features)}
    paired = OrderedScan(rows, [], ["__mix", *identity]).previous(donor).result()
    # the very first row of the order has no donor and leaves the comparison
    first = rows.agg(F.min(F.struct("__mix", *identity)).alias("m")).scalar()
    paired = paired.where(F.struct("__mix", *identity) != first)
    variants = paired.withColumn("__swap", F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])))
    swapped = variants.withColumns({
        c: F.when(F.col("__swap") == i, F.col(f"__d{i}")).otherwise(F.col(c)) for i, c in enumerate(features)
    })
    keep = swapped.select(F.xxhash64(*identity, "__mix").alias("row"), F.col("__swap").alias("swap"), *features)
    scored = fitted.model.transform(fitted.prep.transform(keep)).select("row", "swap", vector_to_array("probability")[1].alias("s"))
    # all variants of a row meet in one small group: (features + 1) scores
    by_row = scored.groupBy("row").agg(
        F.max(F.when(F.col("swap") == -1, F.col("s"))).alias("base"),
        F.collect_list(F.when(F.col("swap") >= 0, F.struct("swap", "s"))).alias("all"),
    )
    changes = by_row.select(F.explode("all").alias("v"), "base").groupBy("v.swap").agg(
        F.avg(F.abs(F.col("v.s") - F.col("base"))).alias("mean_abs_change")
    )
    names = F.array(*[F.lit(c) for c in features])
    return changes.select(F.get(names, F.col("swap")).alias("feature"), "mean_abs_change").orderBy(
        F.desc("mean_abs_change"), "feature"
    ).limit(top)

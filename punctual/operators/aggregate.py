"""Grouped and whole-table summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.clock import floor_hour
from punctual.functions.values import AMOUNT_BUCKETS, amount_bucket, equal_width_bin, exact
from punctual.operators.quantile import exact_quantiles


def exact_mean(c: Column) -> Column:
    """Mean of a two-decimal measure that does not depend on row order."""
    return F.sum(exact(c)).cast("double") / F.count(exact(c))


def present(c: Column) -> Column:
    """Share of non-null values; 0 on an empty input."""
    return F.coalesce(F.avg(c.isNotNull().cast("int")), F.lit(0.0))


def entity_hour_stats(df: DataFrame, entity: str, time: str, delay: str, flag: str) -> DataFrame:
    """Mean delay and mean flag per entity and hour; rows without entity or hour are left out."""
    return (
        df.select(entity, floor_hour(F.col(time)).alias("hour"), delay, flag)
        .dropna(subset=[entity, "hour"])
        .groupBy(entity, "hour")
        .agg(exact_mean(F.col(delay)).alias("avg_delay"), F.avg(flag).alias("delay_rate"))
    )


def rate_by(df: DataFrame, key: str | Column, flag: str, keep_null: bool = True, name: str | None = None) -> DataFrame:
    """Mean of the flag and number of rows per key."""
    column = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    narrow = df.select(column.alias(name), F.col(flag).alias("__flag"))
    if not keep_null:
        narrow = narrow.where(F.col(name).isNotNull())
    return narrow.groupBy(name).agg(F.avg("__flag").alias("delay_rate"), F.count(F.lit(1)).alias("flights"))


def rate_by_bucket(df: DataFrame, amount: str, flag: str) -> DataFrame:
    """Rate and rows per amount class; classes without rows are kept with 0 rows."""
    # the class list has a fixed length of five
    labels = df.sparkSession.createDataFrame([(b[0],) for b in AMOUNT_BUCKETS], "bucket string")
    rates = rate_by(df, amount_bucket(F.col(amount)), flag, keep_null=False, name="bucket")
    return labels.join(rates, "bucket", "left").fillna(0, subset=["flights"])


def top_then_resort(rates: DataFrame, n: int = 15) -> DataFrame:
    """The n largest groups, lowest rate first."""
    key = rates.columns[0]
    return rates.orderBy(F.desc("flights"), key).limit(n).orderBy("delay_rate", key)


def count_mean_median(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    """Non-null count, mean and exact median per key (null key included), rounded."""
    basic = df.groupBy(key).agg(F.count(value).alias("count"), F.round(exact_mean(F.col(value)), digits).alias("mean"))
    medians = exact_quantiles(df, [value], [0.5], keys=[key]).select(
        F.col(key).alias("__key"), F.round("quantile", digits).alias("median")
    )
    return basic.join(medians, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def group_mean_flags(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.round(F.avg(f), 4).alias(f) for f in flags])


def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key; nulls are equal."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def dedupe_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order``.

    An aggregate rather than a window: copies collapse before the shuffle, so a key with a
    third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in set(key)]
    lead = [*order, *[c for c in rest if c not in set(order)]]
    best = df.groupBy(*key).agg(F.min(F.struct(*lead)).alias("__first"))
    return best.select(*[F.col(c) if c in set(key) else F.col(f"__first.{c}") for c in df.columns])


def distinct_entities(df: DataFrame, pairs: Sequence[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """Distinct upper-case (entity, region) pairs over several column pairs, null pairs left out."""
    parts = [df.select(F.col(a).alias(names[0]), F.col(b).alias(names[1])) for a, b in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.dropna().select(*[F.upper(F.col(n).cast("string")).alias(n) for n in names]).distinct()


def missing_rates(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Share of nulls per column, one pass; optionally the highest few."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "feature", "missing_rate")
    return long if top is None else long.orderBy(F.desc("missing_rate"), "feature").limit(top)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of rows per value, null included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("rows") / total.scalar())


def entity_profile(df: DataFrame, key: str, flag: str, means: dict[str, str]) -> DataFrame:
    """Rows, rate and some means per entity; missing means are 0, the null entity is kept."""
    profile = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("flights"),
        F.avg(flag).alias("delay_rate"),
        *[F.avg(c).alias(n) for n, c in means.items()],
    )
    return profile.fillna(0.0, subset=["delay_rate", *means])


def cluster_summary(clustered: DataFrame, means: dict[str, str], cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(n) for n, c in means.items()]
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str], key: str = "model") -> DataFrame:
    """Mean and sample standard deviation of each metric per model."""
    return folds.groupBy(key).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics]
    )


def corrected_skewness(c: Column) -> Column:
    """Sample skewness with bias correction; null below three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness_table(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Corrected skewness per column, one pass; optionally the largest by size."""
    wide = df.agg(*[corrected_skewness(F.col(c).cast("double")).alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "feature", "skew").where(F.col("skew").isNotNull())
    return long if top is None else long.orderBy(F.desc(F.abs("skew")), "feature").limit(top)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows that have both values; null where one of them does not vary.

    Spark's ``corr`` raises on a constant column in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of all column pairs, one pass; tidy (left, right, corr)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[pearson(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{i}`").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    long = wide.select(F.inline(F.array(*cells)))
    mirrored = long.where("left <> right").select(
        F.col("right").alias("left"), F.col("left").alias("right"), "corr"
    )
    return long.unionByName(mirrored)


def pearson_with(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Correlation of each column with each target, one row per column."""
    wide = df.agg(
        *[
            pearson(F.col(c).cast("double"), F.col(t).cast("double")).alias(f"{i}_{j}")
            for i, c in enumerate(columns)
            for j, t in enumerate(targets)
        ]
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{j}").alias(t) for j, t in enumerate(targets)])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, value: str, low: float = 0, high: float = 240, bins: int = 60) -> DataFrame:
    """Rows per equal-width bin of the clipped value; nulls are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(equal_width_bin(F.col(value), low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_years(df: DataFrame, day: str) -> DataFrame:
    return df.select(F.year(day).alias("year")).dropna().distinct()


def prefer_if_any(df: DataFrame, key: Sequence[str], preferred: Column) -> DataFrame:
    """The preferred rows of a key if it has any, else all its rows."""
    flagged = df.withColumn("__ok", F.coalesce(preferred, F.lit(False)))
    any_ok = flagged.groupBy(*key).agg(F.max("__ok").alias("__any"))
    match = None
    for i, k in enumerate(key):
        any_ok = any_ok.withColumnRenamed(k, f"__k{i}")
        part = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        match = part if match is None else match & part
    return (
        flagged.join(any_ok, match)
        .where(F.col("__ok") | ~F.col("__any"))
        .drop("__ok", "__any", *[f"__k{i}" for i in range(len(key))])
    )


def stage_reduction(stages: DataFrame, position: str = "position", rows: str = "rows") -> DataFrame:
    """Rows lost at each stage and the share kept from the stage before and from the first.

    The input has one row per stage of a pipeline, so it is as short as the pipeline.
    """
    w = Window.orderBy(position)
    before = F.lag(rows).over(w)
    return stages.select(
        "*",
        (before - F.col(rows)).alias("rows_removed_from_previous"),
        F.try_divide(F.col(rows), before).alias("share_retained_from_previous"),
        F.try_divide(F.col(rows), F.first(rows).over(w)).alias("share_retained_from_full"),
    )


def dense_rank_abs(df: DataFrame, value: str, name: str) -> DataFrame:
    """Dense rank by size, largest first; null stays null.  For tables with one row per feature."""
    w = Window.orderBy(F.desc_nulls_last(F.abs(value)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.dense_rank().over(w)))


def ordered_unique(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, with the position where it is first seen."""
    return df.groupBy(value).agg(F.min(position).alias(position))

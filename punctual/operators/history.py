"""Features from the past of a row, never from its future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.clock import floor_hour
from punctual.functions.values import EXACT, exact
from punctual.operators.aggregate import exact_mean
from punctual.operators.scan import OrderedScan, RowSample

_LAST_INSTANT = 9223372036854775807
#: Type of saved sums; adding to them does not widen it.
_TOTAL = "decimal(38,6)"


def time_order(df: DataFrame, time: str, tie_order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the sort position of a time (rows without one last) and name the sort columns."""
    moment = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_LAST_INSTANT))
    return df.withColumn("__at", moment), ["__at", *tie_order]


def prior_means(
    df: DataFrame,
    time: str,
    value: str,
    features: dict[str, Sequence[str]],
    tie_order: Sequence[str],
    null_as_zero: bool = True,
    buckets: int | None = None,
    source: DataFrame | None = None,
    earlier: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Mean of the value over earlier rows with the same keys; null for the first row.

    ``features`` maps the new column to its keys.  Null keys form a group.  With
    ``null_as_zero`` a row without a value counts as 0, else it is left out.  Sums are exact
    decimals, so a feature does not depend on how the rows were spread.  ``earlier`` holds, for each feature,
    what rows before all of these add up to (see ``mean_totals``).
    """
    base = df if source is None else source
    amount, counted = _measured(value, null_as_zero)
    out, order = time_order(df, time, tie_order)
    base, _ = time_order(base, time, tie_order)
    sample = RowSample(base, [*[k for keys in features.values() for k in keys], *order], buckets)
    for name, keys in features.items():
        scan = OrderedScan(out, keys, order, source=base, sample=sample).prior_sums({"__sum": amount, "__n": counted})
        out = scan.result()
        total, n = F.col("__sum"), F.col("__n")
        if earlier is not None:
            out = _attach_by_key(out, earlier[name].withColumnsRenamed({"sum": "__before", "n": "__times"}), keys)
            total, n = _added(total, F.col("__before")), _added(n, F.col("__times"))
        out = out.withColumn(name, total.cast("double") / n).drop("__sum", "__n", "__before", "__times")
    return out.drop("__at")


def _measured(value: str, null_as_zero: bool) -> tuple[Column, Column]:
    amount = exact(F.col(value))
    if null_as_zero:
        return F.coalesce(amount, F.lit(0).cast(EXACT)), F.lit(1).cast("bigint")
    return amount, F.when(amount.isNotNull(), 1).cast("bigint")


def _added(a: Column, b: Column) -> Column:
    """The sum of two numbers, the other one where one is null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _attach_by_key(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null.  No hint: small tables are broadcast by measured size, and
    adaptive execution splits the rows of a hot key."""
    renamed = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, match, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def mean_totals(
    df: DataFrame, time: str, value: str, features: dict[str, Sequence[str]], null_as_zero: bool = True,
    earlier: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """For each feature of ``prior_means`` a table (keys.., sum, n) of all rows with a time, ``earlier`` included."""
    amount, counted = _measured(value, null_as_zero)
    timed = df.where(F.col(time).isNotNull())
    out = {}
    for name, keys in features.items():
        rows = timed.select(*keys, amount.alias("sum"), counted.alias("n"))
        if earlier is not None:
            rows = rows.unionByName(earlier[name])
        out[name] = rows.groupBy(*keys).agg(F.sum("sum").cast(_TOTAL).alias("sum"), F.sum("n").alias("n"))
    return out


def prior_count_in_hour(
    df: DataFrame,
    time: str,
    entity: str,
    name: str,
    tie_order: Sequence[str],
    buckets: int | None = None,
    source: DataFrame | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """How many earlier rows the entity has in the same hour; ``earlier`` has those before all of these (see
    ``hour_totals``)."""
    timed = lambda f: time_order(f.withColumn("__hour", floor_hour(F.col(time).cast("timestamp"))), time, tie_order)
    ordered, order = timed(df)
    base = None if source is None else timed(source)[0]
    out = OrderedScan(ordered, [entity, "__hour"], order, buckets, base).prior_count(name).result()
    if earlier is not None:
        out = _attach_by_key(out, earlier.select(F.col("entity").alias(entity), F.col("hour").alias("__hour"), F.col("n").alias("__times")), [entity, "__hour"])
        out = out.withColumn(name, F.col(name) + F.coalesce("__times", F.lit(0))).drop("__times")
    return out.drop("__hour", "__at")


def hour_totals(df: DataFrame, time: str, entity: str, earlier: DataFrame | None = None) -> DataFrame:
    """(entity, hour, n) of the last hour that has rows, the only one that later rows can share."""
    hour = floor_hour(F.col(time).cast("timestamp"))
    rows = df.where(F.col(time).isNotNull()).select(F.col(entity).alias("entity"), hour.alias("hour"), F.lit(1).cast("bigint").alias("n"))
    if earlier is not None:
        rows = rows.unionByName(earlier)
    totals = rows.groupBy("entity", "hour").agg(F.sum("n").alias("n"))
    return totals.where(F.col("hour") == rows.agg(F.max("hour")).scalar())


def previous_leg(
    df: DataFrame,
    time: str,
    entity: str,
    value: str,
    name: str,
    flag: str,
    tie_order: Sequence[str],
    reference_compat: bool = False,
    buckets: int | None = None,
    source: DataFrame | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """The value of the entity's row before, and whether there is one.

    Rows without an entity have no earlier leg; ``reference_compat`` chains them to each other.
    Without the entity column the value is null and the flag 0.  ``earlier`` has the last legs before all of
    these rows (see ``last_legs``).
    """
    if entity not in df.columns:
        return df.withColumns({name: F.lit(None).cast("double"), flag: F.lit(0)})
    ordered, order = time_order(df, time, tie_order)
    base = None if source is None else time_order(source, time, tie_order)[0]
    scan = OrderedScan(ordered, [entity], order, buckets, base).previous({"__leg": F.col(value), "__any": F.lit(True)})
    out = scan.result()
    if earlier is not None:
        out = _attach_by_key(out, earlier.select(F.col("entity").alias(entity), F.col("value").alias("__last")), [entity])
        out = out.withColumn("__leg", F.when(F.col("__any"), F.col("__leg")).otherwise(F.col("__last"))).drop("__last")
    out = out.drop("__any")
    leg = F.col("__leg") if reference_compat else F.when(F.col(entity).isNotNull(), F.col("__leg"))
    return out.withColumn(name, leg).withColumn(flag, F.col(name).isNotNull().cast("int")).drop("__leg", "__at")


def last_legs(
    df: DataFrame, time: str, entity: str, value: str, tie_order: Sequence[str], earlier: DataFrame | None = None
) -> DataFrame:
    """(entity, value): the value in the last row with a time of every entity."""
    order = F.struct(F.lit(1), F.unix_micros(F.col(time).cast("timestamp")), *[F.col(c) for c in tie_order])
    last = df.where(F.col(time).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.max_by(F.struct(F.col(value).alias("value")), order).alias("last"))
    last = last.select("entity", "last.value")
    if earlier is None:
        return last
    new = last.select(F.col("entity").alias("__new"))
    return last.unionByName(earlier.join(new, F.col("entity").eqNullSafe(F.col("__new")), "left_anti"))


def previous_period_features(
    df: DataFrame,
    time: str,
    delay: str,
    flag: str,
    entities: dict[str, str],
    rolling: Sequence[str] = (),
    hour: str = "dep_hour",
) -> DataFrame:
    """Mean delay of the entity's previous observed hour and its flag rate over the last three.

    ``entities`` maps an entity column to the prefix of its features; the rate is added for the
    prefixes in ``rolling``.

    Per entity the facts are reduced map-side to exact sums per hour, always from the facts
    themselves, so the work grows with the number of entities and not with its powers.  The
    windows over the hours hold at most one row per hour.  The hour tables join back without a
    hint: small ones are broadcast by measured size, and for large ones adaptive execution splits
    a crowded (entity, hour).
    """
    facts = df.withColumn(hour, floor_hour(F.col(time).cast("timestamp")))
    out = facts
    for entity, prefix in entities.items():
        hourly = (
            facts.where(F.col(entity).isNotNull() & F.col(hour).isNotNull())
            .groupBy(F.col(entity).alias("__e"), F.col(hour).alias("__h"))
            .agg(exact_mean(F.col(delay)).alias("avg_delay"), F.avg(flag).alias("delay_rate"))
        )
        by_hour = Window.partitionBy("__e").orderBy("__h")
        features = [F.lag("avg_delay").over(by_hour).alias(f"{prefix}_avg_dep_delay_prev_hour")]
        if prefix in rolling:
            recent = by_hour.rowsBetween(-3, -1)
            features.append(F.avg("delay_rate").over(recent).alias(f"{prefix}_delay_rate_prev_3h"))
        shifted = hourly.select("__e", "__h", *features)
        same = (F.col(entity) == F.col("__e")) & (F.col(hour) == F.col("__h"))
        out = out.join(shifted, same, "left").drop("__e", "__h")
    return out

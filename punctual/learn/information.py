"""Mutual information of a number and a class by distances to nearest neighbours.

For a row with value x in class c, r is the distance to its k-th nearest row of the same class, and m the number
of rows of any class nearer than r (itself included; with r = 0 those equal to x, and k becomes the number of
other rows of the class that are equal to x, so that ties don't look like a loss of information).  With N rows, of which
N_c are in the class, the estimate is digamma(N) + mean(digamma(k)) - mean(digamma(N_c)) - mean(digamma(m)), 0 at
least.  Classes of a single row are left out; a class of k rows or fewer uses one less than its size for k.

Equal values of a class count once with their number.  The k-th distance on a sorted axis is found among the k
values before and after: rows are numbered by ``OrderedScan``, cut into blocks of positions that overlap by k,
and lag and lead do the rest.  The numbers m are differences of running counts on the axis of all
rows, one ordered scan for both ends of every interval.  So no class and no feature ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.scan import OrderedScan
from punctual.session import staged

NEIGHBOURS = 3
#: Positions in a block of the sorted axis.
POSITIONS = 200_000


def digamma(x: Column) -> Column:
    """Digamma of numbers from 1 on, to about 1e-12: six steps up, then the asymptotic series."""
    z = x + F.lit(6.0)
    s = 1 / (z * z)
    tail = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return F.log(z) - 0.5 / z - tail - reduce(add, [1 / (x + F.lit(float(i))) for i in range(6)])


def _kth_distance(points: DataFrame, k: int, buckets: int | None) -> DataFrame:
    """Rows (feature, y, value, n, k, r) from (feature, y, value, n, k)."""
    copies = points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k + 1)).cast("int"))))
    axis = OrderedScan(copies, ["feature", "y"], ["value", "copy"], buckets).prior_count("pos").result()
    block, at = F.floor(F.col("pos") / POSITIONS), F.col("pos") % POSITIONS
    near = F.array_compact(F.array(F.lit(0), F.when(at < k, -1), F.when(at >= POSITIONS - k, 1)))
    axis = axis.withColumn("shift", F.explode(near)).withColumn("block", block + F.col("shift"))
    w = Window.partitionBy("feature", "y", "block").orderBy("pos")
    below = [F.col("value")] + [F.coalesce(F.lag("value", j).over(w), F.lit(float("-inf"))) for j in range(1, k + 1)]
    above = [F.col("value")] + [F.coalesce(F.lead("value", j).over(w), F.lit(float("inf"))) for j in range(1, k + 1)]
    names = {f"b{j}": below[j] for j in range(k + 1)} | {f"a{j}": above[j] for j in range(k + 1)}
    axis = axis.withColumns(names)
    x = F.col("value")
    reach = lambda size: F.least(*[F.greatest(x - F.col(f"b{j}"), F.col(f"a{size - j}") - x) for j in range(size + 1)])
    r = reach(k)
    for size in range(1, k):
        r = F.when(F.col("k") == size, reach(size)).otherwise(r)
    # all copies of a value have the same distance
    axis = axis.withColumn("r", r).where("shift = 0 and copy = 1")
    tied = F.when(F.col("r") == 0, F.col("n") - 1).otherwise(F.col("k"))
    return axis.select("feature", "y", "value", "n", tied.alias("k"), "r")


def neighbour_mutual_information(
    df: DataFrame, columns: Sequence[str], label: str, k: int = NEIGHBOURS, buckets: int | None = None
) -> DataFrame:
    """(feature, mutual_information) in nats.  Nulls and NaN, and rows without a label, are left out; a column
    without usable rows has no row in the result."""
    narrow = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in columns]).where("y is not null")
    long = narrow.unpivot(["y"], list(columns), "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    values = staged(long.groupBy("feature", "y", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = values.groupBy("feature", "y").agg(F.sum("n").alias("size")).where("size > 1")
    points = staged(values.join(sizes, ["feature", "y"]).withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int")))
    told = staged(_kth_distance(points.select("feature", "y", "value", "n", "k"), k, buckets))

    # the axis: values count between the queries for what is below them and for what is up to them
    x, r = F.col("value"), F.col("r")
    below, upto = lambda at: (at.alias("at"), F.lit(0).alias("kind")), lambda at: (at.alias("at"), F.lit(2).alias("kind"))
    ask = lambda when, place, sign: told.where(when).select("feature", "y", "value", *place, F.lit(0).cast("bigint").alias("n"), F.lit(sign).alias("sign"))
    asked = (
        ask("r > 0", below(x + r), 1).unionAll(ask("r > 0", upto(x - r), -1)).unionAll(ask("r = 0", upto(x), 1)).unionAll(ask("r = 0", below(x), -1))
    )
    held = points.select("feature", "y", "value", x.alias("at"), F.lit(1).alias("kind"), "n", F.lit(0).alias("sign"))
    scan = OrderedScan(held.unionAll(asked), ["feature"], ["at", "kind", "y", "value", "sign"], buckets)
    counted = scan.prior_sums({"before": F.col("n")}).result().where("kind <> 1")
    m = counted.groupBy("feature", "y", "value").agg(F.sum(F.col("sign") * F.coalesce("before", F.lit(0))).alias("m"))

    per_value = told.join(m, ["feature", "y", "value"])
    near = per_value.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * digamma(F.col("k").cast("double"))).alias("ks"),
        F.sum(F.col("n") * digamma(F.col("m").cast("double"))).alias("ms"),
    )
    by_class = sizes.groupBy("feature").agg(F.sum(F.col("size") * digamma(F.col("size").cast("double"))).alias("ys"))
    total = F.col("total").cast("double")
    estimate = digamma(total) + (F.col("ks") - F.col("ys") - F.col("ms")) / total
    return near.join(by_class, "feature").select("feature", F.greatest(estimate, F.lit(0.0)).alias("mutual_information"))

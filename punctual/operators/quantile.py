"""Exact quantiles by narrowing down, without shuffling or holding the values of a group.

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here a sketch of bounded size proposes
edges around the wanted ranks, and a pass counts, map-side, how many values lie on each edge and between
two of them.  The counts are exact, so they tell where a rank really lies: on an edge, which is the answer,
or in a gap.  A gap with many values gets edges of its own and is counted again; what is left are gaps with
few rows, and only these rows are grouped by value.  Each pass reads the columns once, for all columns and
probabilities together; between passes there is one row for each group, column and gap.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.session import staged

#: Relative rank error of the sketch (one part in so many), rows of a gap that are grouped by value, edges
#: inside a larger gap, and groups up to which the table of edges is broadcast.
ACCURACY = 10_000
KEEP = 20_000
PARTS = 64
BROADCAST_GROUPS = 100_000


def _matching(rows: DataFrame, small: DataFrame, names: Sequence[str], how: str = "inner", few: bool = True) -> DataFrame:
    """Join on columns that may be null; those of the small side are dropped."""
    renamed = small.withColumnsRenamed({n: f"__g{i}" for i, n in enumerate(names)})
    match = F.lit(True)
    for i, n in enumerate(names):
        match = match & F.col(n).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(F.broadcast(renamed) if few else renamed, match, how).drop(*[f"__g{i}" for i in range(len(names))])


@dataclass
class Edges:
    """Rows (group.., edges: sorted array), written once."""

    table: DataFrame
    few: bool
    longest: int


def _edges(table: DataFrame) -> Edges:
    table = staged(table)
    told = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("edges")).alias("longest")).first()
    return Edges(table, told["n"] <= BROADCAST_GROUPS, told["longest"] or 0)


def _in_cells(long: DataFrame, edges: Edges, group: Sequence[str]) -> DataFrame:
    """Add ``cell``: twice the number of edges below the value, and one more if it lies on an edge."""
    value = F.col("value")
    rows = _matching(long, edges.table, group, few=edges.few)
    # a binary search with one column per step, all of it generated code; beyond the end a step reads null and stays
    below: Column = F.lit(0)
    steps = list(reversed(range(edges.longest.bit_length())))
    for i, s in enumerate(steps):
        step = 1 << s
        rows = rows.withColumn(f"__step{i}", below + F.when(F.get("edges", below + (step - 1)) < value, step).otherwise(0))
        below = F.col(f"__step{i}")
    on = F.when(F.get("edges", below) == value, 1).otherwise(0)
    return rows.withColumn("cell", below * 2 + on).drop("edges", *[f"__step{i}" for i in range(len(steps))])


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    keep: int = KEEP,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Interpolated quantiles: one row (keys.., feature, probability, quantile).

    Nulls and NaN are left out; keys may be null; groups without values have no row.  ``keep`` and
    ``accuracy`` change the number of passes, never the result.
    """
    keys, group = list(keys), [*keys, "feature"]
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = narrow.unpivot(keys, list(columns), "feature", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    error = 2.0 / accuracy
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-error, error)})
    sketch = F.percentile_approx("value", near, accuracy)
    edges = _edges(long.groupBy(*group).agg(F.array_sort(F.array_distinct(sketch)).alias("edges")))

    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), ((F.col("total") - 1) * F.lit(float(p))).alias("at")) for p in probabilities
    ])
    covers = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("n"))
    hits = F.filter(wanted, lambda w: covers(F.floor(w["at"])) | covers(F.ceil(w["at"])))
    edge = lambda i: F.get("edges", i.cast("int"))
    cell = F.col("cell")
    cells = Window.partitionBy(*group).orderBy("cell")
    while True:
        counts = _in_cells(long, edges, group).groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"))
        # a few rows for each group: its cells
        located = _matching(counts, edges.table, group, few=edges.few).withColumns({
            "total": F.sum("n").over(Window.partitionBy(*group)),
            "before": F.coalesce(F.sum("n").over(cells.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        })
        located = staged(located.where(F.size(hits) > 0))
        gaps = located.where(cell % 2 == 0)
        if (gaps.agg(F.max("n")).first()[0] or 0) <= keep:
            break
        # the edges around what is wanted, and new ones inside the crowded gaps
        around = F.when(cell % 2 == 1, F.array(edge((cell - 1) / 2))).otherwise(F.array(edge(cell / 2 - 1), edge(cell / 2)))
        crowded = gaps.where(F.col("n") > keep).select(*group, "cell")
        inside = _matching(_in_cells(long, edges, group), crowded, [*group, "cell"], "left_semi", edges.few)
        parts = F.percentile_approx("value", [i / PARTS for i in range(PARTS + 1)], accuracy)
        found = located.select(*group, around.alias("some")).unionAll(inside.groupBy(*group, "cell").agg(parts.alias("some")).select(*group, "some"))
        every = F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("some")))))
        edges = _edges(found.groupBy(*group).agg(every.alias("edges")))

    on_edges = located.where(cell % 2 == 1).select(*group, edge((cell - 1) / 2).alias("value"), "n", "before", "total")
    wanted_gaps = gaps.select(*group, "cell", F.col("before").alias("__before"), "total")
    open_rows = _matching(_in_cells(long, edges, group), wanted_gaps, [*group, "cell"], few=edges.few)
    values = open_rows.groupBy(*group, "cell", "value").agg(F.count(F.lit(1)).alias("n"), F.first("__before").alias("__before"), F.first("total").alias("total"))
    running = F.sum("n").over(Window.partitionBy(*group, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    inside = values.withColumn("before", F.col("__before") + F.coalesce(running, F.lit(0))).select(*group, "value", "n", "before", "total")

    at = F.col("hit.at")
    picked = on_edges.unionAll(inside).withColumn("hit", F.explode(hits)).select(
        *group,
        F.col("hit.p").alias("probability"),
        (at - F.floor(at)).alias("part"),
        F.when(covers(F.floor(at)), F.col("value")).alias("low"),
        F.when(covers(F.ceil(at)), F.col("value")).alias("high"),
    )
    return (
        picked.groupBy(*group, "probability")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("part").alias("part"))
        .select(
            *group,
            "probability",
            (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"),
        )
    )

"""Ordered calculations per key: running sums, previous value, last known value.

A plain ``Window.partitionBy(key).orderBy(time)`` puts every row of a key into one task.
When one key holds a third of the data that task never ends.  ``OrderedScan`` therefore
cuts the (key, order) space into range buckets of about equal size:

1. rows are counted, and each partition draws its rows at a rate that makes about PER_BUCKET
   rows a bucket in all; nothing is sorted or gathered in a task.  The sample gives up to FIRST - 1
   borders, which sit in the plan as one literal and are looked up by binary search.  Where more
   buckets are asked for, a second, denser sample is cut inside each of the first ranges by
   an aggregate, and the finer borders are a table with one array per range;
2. inside a bucket a plain window does the work;
3. what earlier buckets of the same key contribute is one small table with at most one row per
   border.  Only rows whose key is the key of a neighbouring border are aggregated for it: no
   other key reaches over a border.

So rows are shuffled once and no group is larger than a bucket, at any size of the input and
without a ceiling on the number of buckets.  Where the borders lie only affects balance, never
results.  The order columns should identify a row: rows equal in all of them share a bucket.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.session import staged

#: Rows that a bucket should hold, the fewest buckets, and the rows drawn for each bucket.
TARGET_ROWS = 2_000_000
LEAST_BUCKETS = 8
PER_BUCKET = 64
#: Ranges of the first level, whose borders are a literal; more buckets are cut inside them.
FIRST = 1024
#: Borders up to which the tables with a row per border are broadcast.
BROADCAST_BORDERS = 200_000
_SPAN = 1 << 20

_BUCKET = "__bucket"


def _comparable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns as JSON-friendly values in the same order as the originals."""
    out = []
    for i, name in enumerate(names):
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            c = F.unix_date(c)
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f"c{i}"))
    return out


class RowSample:
    """Row count and a bounded sample of some columns, drawn once for all scans over a frame.

    The sample holds about PER_BUCKET rows for each of the first ranges, so at most about
    PER_BUCKET * FIRST rows reach the driver, whatever the size of the frame and the number of its
    partitions.
    """

    def __init__(self, df: DataFrame, names: Sequence[str], buckets: int | None = None):
        self.names = list(dict.fromkeys(names))
        self.df = df.select(*self.names)
        self._asked = buckets

    @cached_property
    def rows(self) -> int:
        return self.df.count()

    @property
    def buckets(self) -> int:
        return self._asked or max(LEAST_BUCKETS, math.ceil(self.rows / TARGET_ROWS))

    def drawn(self, wanted: int, seed: int) -> DataFrame:
        """About ``wanted`` rows, drawn where they are."""
        rate = wanted / max(self.rows, 1)
        return self.df if rate >= 1 else self.df.where(F.rand(seed) < rate)

    @cached_property
    def points(self) -> list[tuple]:
        places = self.drawn(PER_BUCKET * min(self.buckets, FIRST), 42).select(*_comparable(self.df, self.names))
        return [tuple(r) for r in places.collect()]


@dataclass
class Borders:
    """Border tuples of the first level and, if there are more buckets than those make, a table
    (__first, __fine: sorted array of border structs) of the second."""

    names: list[str]
    first: list[tuple]
    fine: DataFrame | None = None
    buckets: int = 1

    @property
    def few(self) -> bool:
        """Whether a table with a row per border may be broadcast."""
        return self.buckets <= BROADCAST_BORDERS


def range_borders(df: DataFrame, names: Sequence[str], buckets: int | None = None) -> list[tuple]:
    """Border tuples that cut the rows into about equal parts, FIRST at most."""
    return cut(RowSample(df, names, buckets), names).first


def cut(sample: RowSample, names: Sequence[str]) -> Borders:
    """Borders of the sampled frame by ``names``, which are columns of the sample."""
    names, buckets = list(names), sample.buckets
    if buckets == 1:
        return Borders(names, [])
    at = [sample.names.index(n) for n in names]
    points = {tuple(p[i] for i in at) for p in sample.points}
    points = {p for p in points if not any(isinstance(v, float) and math.isnan(v) for v in p)}
    points = sorted(points, key=lambda p: [(v is not None, v if v is not None else 0) for v in p])
    step = len(points) / min(buckets, FIRST)
    picks = sorted({int(step * i) for i in range(1, min(buckets, FIRST))} - {0})
    found = Borders(names, [points[i] for i in picks if i < len(points)], None, buckets)
    if buckets > FIRST:
        rows = with_range_bucket(sample.drawn(PER_BUCKET * buckets, 43), found).select(
            F.col(_BUCKET).alias("__first"), F.struct(*_comparable(sample.df, names)).alias("__place")
        )
        places = F.array_sort(F.array_distinct(F.collect_list("__place")))
        every = lambda x, i: (i % PER_BUCKET == PER_BUCKET - 1)
        found.fine = rows.groupBy("__first").agg(F.filter(places, every).alias("__fine"))
        # cut once: the borders must be the same wherever they are looked up
        found.fine = staged(found.fine)
    return found


def _search(df: DataFrame, table: Column, length: int, name: str) -> DataFrame:
    """Add how many entries of a sorted array are at or below ``__place``.

    A binary search with one column per step, so that all of it is generated code.  Beyond the
    end of the array a step reads null and does not move.  A handful of entries is compared in a
    single expression, which is quicker to plan.
    """
    if length <= 15:
        reached = [F.when(F.get(table, F.lit(i)) <= F.col("__place"), 1).otherwise(0) for i in range(length)]
        return df.withColumn(name, reduce(add, reached, F.lit(0)))
    low: Column = F.lit(0)
    steps = list(reversed(range(length.bit_length())))
    for i, s in enumerate(steps):
        step = 1 << s
        reached = F.get(table, low + (step - 1)) <= F.col("__place")
        df = df.withColumn(f"__step{i}", low + F.when(reached, step).otherwise(0))
        low = F.col(f"__step{i}")
    return df.withColumn(name, low).drop(*[f"__step{i}" for i in range(len(steps))])


def _literal(points: Sequence[tuple], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps([{f"c{i}": v for i, v in enumerate(p)} for p in points])), f"array<{kind}>")


def with_range_bucket(df: DataFrame, borders: Borders) -> DataFrame:
    """Add the bucket number of each row, in the order of the ranges."""
    if not borders.first:
        return df.withColumn(_BUCKET, F.lit(0))
    df = df.withColumn("__place", F.struct(*_comparable(df, borders.names)))
    table = _literal(borders.first, df.schema["__place"].dataType.simpleString())
    df = _search(df, table, len(borders.first), _BUCKET)
    if borders.fine is not None:
        fine = borders.fine.withColumnRenamed("__first", _BUCKET)
        df = df.join(F.broadcast(fine) if borders.few else fine, _BUCKET, "left")
        longest = borders.fine.agg(F.max(F.size("__fine"))).first()[0] or 1
        df = _search(df, F.col("__fine"), longest, "__inner").drop("__fine")
        df = df.withColumn(_BUCKET, F.col(_BUCKET) * _SPAN + F.col("__inner")).drop("__inner")
    return df.drop("__place")


def reaching_over(df: DataFrame, borders: Borders, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is the key of a border: no other key has rows in two buckets."""
    if not borders.first or not keys:
        return df if borders.first else df.limit(0)
    own = _comparable(df, borders.names)
    kind = df.select(F.struct(*own).alias("p")).schema["p"].dataType.simpleString()
    held = df.sparkSession.range(1).select(F.explode(_literal(borders.first, kind)).alias("b"))
    if borders.fine is not None:
        held = held.unionAll(borders.fine.select(F.explode("__fine").alias("b")))
    held = held.select(*[F.col(f"b.c{i}").alias(f"__b{i}") for i in range(len(keys))]).distinct()
    match = F.lit(True)
    for i, c in enumerate(own[: len(keys)]):
        match = match & c.eqNullSafe(F.col(f"__b{i}"))
    return df.join(F.broadcast(held) if borders.few else held, match, "left_semi")


class OrderedScan:
    """Ordered calculations over ``order`` within each combination of ``keys``.

    Null keys form a group of their own.  ``buckets`` forces a bucket count; by default it
    follows from the number of rows.

    ``source`` is an earlier frame with the same rows that already holds keys, order and the
    columns the calculations read.  In a chain of scans it keeps the work linear: what earlier
    buckets contribute is then taken from the source, not from the chain so far.  ``sample`` holds
    keys and order of the same rows; several scans over one frame can share it.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        buckets: int | None = None,
        source: DataFrame | None = None,
        sample: RowSample | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        source = df if source is None else source
        names = self.keys + self.order
        borders = cut(sample or RowSample(source, names, buckets), names)
        self.df = with_range_bucket(df, borders)
        self.whole = source
        # only these rows can have something to hand on
        self.source = with_range_bucket(reaching_over(source, borders, self.keys), borders)
        self.few = borders.few
        self.listed = borders.fine is None and not any(
            isinstance(source.schema[k].dataType, T.DecimalType) for k in self.keys
        )
        self.group = [*self.keys, _BUCKET]

    # -- helpers ---------------------------------------------------------------------
    def _window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def _order_struct(self) -> Column:
        return F.struct(*self.order)

    def _carry(self, aggregates: list[Column], over_earlier) -> DataFrame:
        """One row per (key, bucket) that has an earlier bucket of the same key."""
        per_bucket = self.source.groupBy(*self.group).agg(*aggregates)
        earlier = Window.partitionBy(*self.keys).orderBy(_BUCKET)
        position = F.row_number().over(earlier)
        carried = per_bucket.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)],
            F.col(_BUCKET).alias("__kb"),
            *over_earlier(earlier),
            position.alias("__pos"),
        )
        return carried.where("__pos > 1").drop("__pos")

    def _attach(self, carry: DataFrame) -> DataFrame:
        if self.listed:
            return self._looked_up(carry)
        match = F.col(_BUCKET) == F.col("__kb")
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        # every border adds at most one (key, bucket) pair
        joined = self.df.join(F.broadcast(carry) if self.few else carry, match, "left")
        return joined.drop("__kb", *[f"__k{i}" for i in range(len(self.keys))])

    def _looked_up(self, carry: DataFrame) -> DataFrame:
        """The same without a join: the ranges of the first level are numbered from 0, and only the key that
        a bucket begins with can have rows in an earlier one, so the carried values are an array with at most one
        entry per bucket.  A column that nobody reads is left out of the plan with all it hangs on.

        Keys that are compared in a coarser form (decimals) are joined.
        """
        kept = [c for c in carry.columns if c != "__kb"]
        entries = carry.agg(F.collect_list(F.struct("__kb", *kept)).alias("e"))
        by_bucket = F.map_from_entries(F.transform("e", lambda s: F.struct(s["__kb"], s)))
        last = F.array_max(F.transform("e", lambda s: s["__kb"]))
        listed = entries.select(F.transform(F.sequence(F.lit(0), last), lambda b: F.try_element_at(by_bucket, b)).alias("listed"))
        out = self.df.withColumn("__entry", F.get(listed.scalar(), F.col(_BUCKET)))
        match = F.col("__entry").isNotNull()
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"__entry.__k{i}"))
        values = [c for c in kept if not c.startswith("__k")]
        return out.withColumns({c: F.when(match, F.col(f"__entry.{c}")) for c in values}).drop("__entry")

    # -- calculations ----------------------------------------------------------------
    def prior_sums(self, sums: dict[str, Column]) -> OrderedScan:
        """Add the sum of each expression over earlier rows; null where there are none."""
        before = self._window().rowsBetween(Window.unboundedPreceding, -1)
        frame = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        names = list(sums)
        carry = self._carry(
            [F.sum(sums[n]).alias(n) for n in names],
            lambda w: [F.sum(n).over(frame(w)).alias(f"__c{i}") for i, n in enumerate(names)],
        )
        joined = self._attach(carry).withColumns({f"__w{i}": F.sum(sums[n]).over(before) for i, n in enumerate(names)})
        for i, n in enumerate(names):
            here, there = F.col(f"__w{i}"), F.col(f"__c{i}")
            total = F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
            joined = joined.withColumn(n, total)
        self.df = joined.drop(*[f"__w{i}" for i in range(len(names))], *[f"__c{i}" for i in range(len(names))])
        return self

    def prior_count(self, name: str) -> OrderedScan:
        """Add the number of earlier rows."""
        self.prior_sums({name: F.lit(1).cast("bigint")})
        self.df = self.df.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
        return self

    def previous(self, columns: dict[str, Column]) -> OrderedScan:
        """Add the value each expression had in the row just before; null for the first row."""
        payload = F.struct(*[e.alias(n) for n, e in columns.items()])
        here = F.lag(payload).over(self._window())
        carry = self._carry(
            [F.max_by(payload, self._order_struct()).alias("__last")],
            lambda w: [F.lag("__last").over(w).alias("__carried")],
        )
        self.df = (
            self._attach(carry)
            .withColumn("__here", here)
            .withColumn("__prev", F.coalesce("__here", "__carried"))
            .drop("__here", "__carried")
        )
        for n in columns:
            self.df = self.df.withColumn(n, F.col(f"__prev.{n}"))
        self.df = self.df.drop("__prev")
        return self

    def last_known(self, name: str, payload: Column) -> OrderedScan:
        """Add the latest non-null payload at or before each row."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = F.last(payload, ignorenulls=True).over(upto)
        carry = self._carry(
            [F.max_by(payload, F.when(payload.isNotNull(), self._order_struct())).alias("__last")],
            lambda w: [
                F.last("__last", ignorenulls=True)
                .over(w.rowsBetween(Window.unboundedPreceding, -1))
                .alias("__carried")
            ],
        )
        self.df = (
            self._attach(carry)
            .withColumn("__here", here)
            .withColumn(name, F.coalesce("__here", "__carried"))
            .drop("__here", "__carried")
        )
        return self

    def key_totals(self, sums: dict[str, Column]) -> OrderedScan:
        """Add the sum of each expression over all rows of the key."""
        per_key = self.whole.groupBy(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(self.keys)]).agg(
            *[F.sum(e).alias(n) for n, e in sums.items()]
        )
        if not self.keys:
            self.df = self.df.withColumns({n: per_key.select(n).scalar() for n in sums})
            return self
        match = F.lit(True)
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"__t{i}"))
        # one row per key against all rows: adaptive execution broadcasts the totals if they are
        # small and splits the rows of a hot key if not
        self.df = self.df.join(per_key, match).drop(*[f"__t{i}" for i in range(len(self.keys))])
        return self

    def result(self) -> DataFrame:
        return self.df.drop(_BUCKET)

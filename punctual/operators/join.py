"""Joins: dimensions, as-of matches, metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.scan import OrderedScan, RowSample


def attach_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Left join of some dimension columns (source: new name).

    No hint is given: Catalyst broadcasts the dimension when its measured size allows and
    otherwise joins by shuffle, where adaptive execution splits a hot key.
    """
    renamed = dim.select(F.col(dim_key).alias("__dim"), *[F.col(s).alias(n) for s, n in columns.items()])
    return df.join(renamed, F.col(key) == F.col("__dim"), "left").drop("__dim")


def repeated_keys(dim: DataFrame, key: str) -> DataFrame:
    """Dimension keys that occur more than once, i.e. would multiply rows in a join."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_time: str,
    right_time: str,
    payload: dict[str, str],
    tolerance: str | None,
    tie_order: Sequence[str] = (),
    buckets: int | None = None,
    source: DataFrame | None = None,
    mix: str | None = None,
) -> DataFrame:
    """Attach to each left row the latest right row of its key at or before its time.

    ``payload`` maps new names to right columns; the matched row is taken whole, so a null in
    it stays null.  Of equal right times the last by ``tie_order`` wins.  A match older than
    ``tolerance`` (an interval such as ``3 HOURS``, itself included) counts as none.  Left
    rows without key or time stay, with nulls.

    Both sides are stacked and scanned once in time order per key, so no pair of rows is ever
    built; ``OrderedScan`` splits hot keys.  ``source`` is an earlier frame with the rows of
    ``left`` (see there).  Left rows of one key and time are dealt out by a hash of the whole row, or by
    ``mix``, a bigint column that has such a hash already: then only key, time and it are read to find the borders.
    """
    wanted = [F.col(s).alias(n) for n, s in payload.items()]
    right_rows = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(right_key).alias("__key"),
        F.col(right_time).cast("timestamp").alias("__time"),
        F.struct(F.col(right_time).cast("timestamp").alias("__rt"), *wanted).alias("__right"),
        *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie_order)],
    )
    # of several right rows with one key and time only the last can win: keep that one
    if tie_order:
        order = F.struct(*[F.col(f"__tie{i}") for i in range(len(tie_order))])
        right_rows = right_rows.groupBy("__key", "__time").agg(F.max_by("__right", order).alias("__right"))
    else:
        right_rows = right_rows.groupBy("__key", "__time").agg(F.max("__right").alias("__right"))

    right_type = right_rows.schema["__right"].dataType.simpleString()
    hashed = F.xxhash64(*(left if source is None else source).columns) if mix is None else F.col(mix)

    def stack(side: DataFrame) -> DataFrame:
        rows = side.select(
            "*",
            F.col(left_key).alias("__key"),
            F.col(left_time).cast("timestamp").alias("__time"),
            F.lit(1).alias("__side"),
            hashed.alias("__mix"),
            F.lit(None).cast(right_type).alias("__right"),
        )
        absent = [F.lit(None).cast(f.dataType.simpleString()).alias(f.name) for f in side.schema]
        return rows.unionAll(
            right_rows.select(
                *absent, "__key", "__time", F.lit(0).alias("__side"), F.lit(0).cast("bigint").alias("__mix"), "__right"
            )
        )

    # rows without a key form a group without observations; rows without a time sort first
    order = ["__time", "__side", "__mix"]
    base = None if source is None else stack(source)
    # where the rows lie is told by keys and times alone, before the sides are widened and reduced
    own = left if source is None else source
    places = own.select(
        F.col(left_key).alias("__key"), F.col(left_time).cast("timestamp").alias("__time"), F.lit(1).alias("__side"),
        hashed.alias("__mix"),
    ).unionAll(right.select(
        F.col(right_key), F.col(right_time).cast("timestamp"), F.lit(0), F.lit(0).cast("bigint"),
    ))
    sample = RowSample(places, ["__key", *order], buckets)
    scan = OrderedScan(stack(left), ["__key"], order, source=base, sample=sample)
    matched = scan.last_known("__match", F.col("__right")).result().where(F.col("__side") == 1)
    found: Column = F.col("__match")
    if tolerance is not None:
        near = F.col("__match.__rt") >= F.col("__time") - F.expr(f"INTERVAL {tolerance}")
        found = F.when(near, found)
    return matched.withColumn("__match", found).select(
        *left.columns, *[F.col(f"__match.{n}").alias(n) for n in payload]
    )


def asof_join_sides(
    left: DataFrame,
    right: DataFrame,
    sides: Sequence[tuple[str, str, dict[str, str]]],
    right_key: str,
    right_time: str,
    tolerance: str | None,
    tie_order: Sequence[str] = (),
    buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Several as-of matches of the same rows, e.g. at both ends of a trip: ``sides`` are (key, time, payload).

    Each match takes its borders and what earlier buckets hand on from the rows as they came in,
    so a later one does not repeat those before it.
    """
    own = left if source is None else source
    for key, time, payload in sides:
        left = asof_join(left, right, key, right_key, time, right_time, payload, tolerance, tie_order, buckets, own)
    return left


def match_candidates(
    entities: DataFrame, stations: DataFrame, entity: str = "airport", long_code: str = "icao", short_code: str = "call"
) -> DataFrame:
    """Entity and station pairs that agree on a code.

    The three ways to agree (long code equal, short code equal, four-letter long code ending
    in the entity's code) are three equality joins instead of one comparison of all pairs.
    """
    by_long = entities.join(stations, F.col(entity) == F.col(long_code))
    by_short = entities.join(stations, F.col(entity) == F.col(short_code))
    ending = stations.where(F.length(long_code) == 4)
    # a suffix of one to four letters, one equality key per length
    tails = ending.withColumn("__tail", F.explode(F.array(*[F.expr(f"right({long_code}, {n})") for n in (1, 2, 3, 4)])))
    by_tail = entities.join(tails, F.col(entity) == F.col("__tail")).drop("__tail")
    return by_long.unionByName(by_short).unionByName(by_tail).distinct()


def name_match(entities: DataFrame, stations: DataFrame, entity: str = "airport", name: str = "station_name") -> DataFrame:
    """Pairs where the station name holds the entity's code as a whole word.

    A code is a run of letters set off by non-letters; splitting the name at non-letters turns
    the pattern match into an equality join.  Codes that hold other characters are matched
    piecewise: their longest letter run finds the candidates, the pattern confirms them.  Codes
    without a letter are looked for in the pieces between letters, cut to the lengths that such
    codes have.
    """
    run = F.expr(
        f"element_at(array_sort(split({entity}, '[^A-Z]+'), "
        "(a, b) -> case when length(a) <> length(b) then length(b) - length(a) "
        "when a < b then -1 when a > b then 1 else 0 end), 1)"
    )
    probes = entities.withColumn("__probe", F.when(run == "", F.col(entity)).otherwise(run)).where(F.col("__probe") != "")
    upper = F.upper(F.coalesce(F.col(name), F.lit("")))
    letters = F.split(upper, "[^A-Z]+")
    # the few lengths of codes without a letter: one small array for the whole plan
    lengths = probes.where(~F.col("__probe").rlike("[A-Z]")).agg(F.collect_set(F.length("__probe")).alias("n")).scalar()
    cut = lambda piece, n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(piece) - n + 1, F.lit(1))), lambda i: F.substring(piece, i, n)
    )
    others = F.flatten(F.transform(F.split(upper, "[A-Z]+"), lambda piece: F.flatten(F.transform(F.col("__lengths"), lambda n: cut(piece, n)))))
    words = stations.withColumn("__lengths", lengths).withColumn("__word", F.explode(F.array_distinct(F.concat(letters, others))))
    words = words.where(F.col("__word") != "").drop("__lengths")
    quoted = F.regexp_replace(F.col(entity), r"([\\\[\](){}.*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("(?:^|[^A-Z])"), quoted, F.lit("(?:[^A-Z]|$)"))
    pairs = probes.join(words, F.col("__probe") == F.col("__word")).where(
        F.regexp_like(F.upper(F.col(name)), pattern)
    )
    return pairs.drop("__probe", "__word").distinct()


def available_periods(rows: DataFrame, entity: str, day: str, periods: DataFrame) -> DataFrame:
    """How many of the wanted years each entity has data for."""
    seen = rows.select(F.col(entity), F.year(day).alias("year")).dropna().distinct()
    return seen.join(periods, "year", "left_semi").groupBy(entity).agg(F.count(F.lit(1)).alias("year_hits"))


def attach_geo_topn(df: DataFrame, positions: DataFrame, key: str, flag: str, n: int = 75) -> DataFrame:
    """Rows and rate of the n busiest entities with a known position."""
    summary = df.groupBy(key).agg(F.count(F.lit(1)).alias("flights"), F.avg(flag).alias("delay_rate"))
    located = summary.join(positions.withColumnRenamed(positions.columns[0], key), key, "left")
    return located.dropna(subset=["latitude", "longitude"]).orderBy(F.desc("flights"), key).limit(n)


def upsert_metrics(existing: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Replace the rows of the models in ``new`` and append their new rows."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def compare_families(models: DataFrame, other: DataFrame, label: str, prefix: str = "") -> DataFrame:
    """The models plus the best row of another family, with a family label, best f1 first."""
    metrics = ["precision", "recall", "f1"]
    best = other.orderBy(F.desc("f1"), F.desc("accuracy"), "model").limit(1)
    ours = models.withColumn("family", F.lit("tabular"))
    theirs = best.select(F.concat(F.lit(prefix), "model").alias("model"), *metrics, F.lit(label).alias("family"))
    return ours.unionByName(theirs, allowMissingColumns=True).orderBy(F.desc("f1"), "model")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


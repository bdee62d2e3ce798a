"""Temporal splits and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def distinct_dates(df: DataFrame, day: str) -> DataFrame:
    """The distinct dates with their 0-based position: one row per calendar day at most."""
    dates = df.select(F.to_date(day).alias("date")).dropna().distinct()
    return dates.withColumn("position", F.row_number().over(Window.orderBy("date")) - 1)


def cut_date(df: DataFrame, day: str, train_share: float = 0.8) -> DataFrame:
    """One row (cut): the first test date; null if there are fewer than two dates."""
    dates = distinct_dates(df, day)
    wanted = dates.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(train_share)), F.lit(1)).alias("at"))
    return dates.where(F.col("position") == wanted.scalar()).agg(F.max("date").alias("cut"))


def temporal_split(df: DataFrame, day: str, train_share: float = 0.8) -> tuple[DataFrame, DataFrame, object]:
    """(train, test, cut): rows before the cut date and rows from it on."""
    cut = cut_date(df, day, train_share).first()["cut"]
    if cut is None:
        raise ValueError("a temporal split needs at least two dates")
    border = F.lit(cut)
    return df.where(F.to_date(day) < border), df.where(F.to_date(day) >= border), cut


def with_split_role(df: DataFrame, day: str, train_share: float = 0.8, name: str = "role") -> DataFrame:
    """Mark rows ``train`` or ``test`` in one lazy plan; the cut date is a scalar subquery."""
    before = F.to_date(day) < cut_date(df, day, train_share).scalar()
    return df.where(F.col(day).isNotNull()).withColumn(name, F.when(before, "train").otherwise("test"))


def fold_table(df: DataFrame, day: str, folds: int) -> DataFrame:
    """(date, fold, role) for expanding folds: train on all earlier blocks, test on the next.

    Dates fall into ``folds + 1`` blocks with borders ``floor(i * n / (folds + 1))``.
    """
    dates = distinct_dates(df, day)
    total = dates.agg(F.count(F.lit(1)).alias("n"))
    numbered = dates.withColumn("n", total.scalar())
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    border = lambda i: F.floor(i * F.col("n") / (folds + 1))
    placed = numbered.where(F.col("n") >= folds + 1).select("date", "position", "n", fold)
    train_end, test_end = border(F.col("fold")), border(F.col("fold") + 1)
    role = F.when(F.col("position") < train_end, "train").when(F.col("position") < test_end, "test")
    return placed.select("date", "fold", role.alias("role")).where(F.col("role").isNotNull())


def with_folds(df: DataFrame, day: str, folds: int) -> DataFrame:
    """Rows once per fold they take part in, with fold and role."""
    table = fold_table(df, day, folds).withColumnRenamed("date", "__date")
    return df.join(table, F.to_date(day) == F.col("__date")).drop("__date")


def temporal_folds(df: DataFrame, day: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) pairs; folds without rows on a side are left out.

    Only the fold borders (two dates per fold) come to the driver.
    """
    marks = (
        fold_table(df, day, folds)
        .groupBy("fold")
        .pivot("role", ["train", "test"])
        .agg(F.max("date"))
        .orderBy("fold")
        .collect()
    )
    if not marks:
        raise ValueError("not enough distinct dates for the folds")
    date = F.to_date(day)
    pairs = []
    for m in marks:
        if m["train"] is not None and m["test"] is not None:
            train_end, test_end = F.lit(m["train"]), F.lit(m["test"])
            pairs.append((df.where(date <= train_end), df.where((date > train_end) & (date <= test_end))))
    return pairs


def sample_hash(identity: Sequence[str], seed: int = SEED) -> Column:
    """Sixty bits that depend on the seed and the row's identity only."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def sample_cap(df: DataFrame, cap: int, identity: Sequence[str], seed: int = SEED) -> DataFrame:
    """All rows up to the cap, else exactly ``cap`` rows: those with the least seeded hash.

    The choice depends on the row identity only.  A cap is a property of this operator; the
    pipelines run on all rows unless one is asked for.

    A histogram of the leading hash bits (65,536 counts at most) tells the stripe of hashes in
    which the cap is reached: lower stripes stay whole, and only the rows of that one stripe are
    ranked.
    """
    marked = df.withColumn("__mix", sample_hash(identity, seed)).withColumn("__stripe", F.shiftright("__mix", 44))
    sizes = marked.groupBy("__stripe").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("__stripe"))
    reach = sizes.select("__stripe", "n", upto.alias("upto")).where(F.col("upto") >= cap)
    last = reach.agg(F.min(F.struct("__stripe", (F.lit(cap) - F.col("upto") + F.col("n")).alias("room"))).alias("last"))
    stripe = F.coalesce(last.select("last.__stripe").scalar(), F.lit(1 << 16))
    whole = marked.where(F.col("__stripe") < stripe)
    rank = F.row_number().over(Window.orderBy("__mix", *identity))
    cut = marked.where(F.col("__stripe") == stripe).withColumn("__rank", rank)
    cut = cut.where(F.col("__rank") <= last.select("last.room").scalar()).drop("__rank")
    return whole.unionByName(cut).drop("__mix", "__stripe")


def stratified_take(
    df: DataFrame, label: str, sizes: dict, identity: Sequence[str], seed: int = SEED
) -> DataFrame:
    """A fixed number of rows per label value, by least seeded hash.

    Each stratum is a distributed top-k, so a label with most of the rows is no hot group.
    """
    parts = [sample_cap(df.where(F.col(label) == value), n, identity, seed) for value, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def balanced_sample(df: DataFrame, label: str, size: int, identity: Sequence[str], seed: int = SEED) -> DataFrame:
    """Half positives; negatives fill up to ``size`` where positives are scarce; mixed by hash."""
    half = size // 2
    positives = sample_cap(df.where(F.col(label) == 1), half, identity, seed)
    negatives = sample_cap(df.where(F.col(label) == 0), size, identity, seed)
    rank = Window.orderBy(sample_hash(identity, seed), *identity)
    # at most ``size`` rows on each side, ``size`` is the caller's sample size
    ranked = negatives.withColumn("__rank", F.row_number().over(rank))
    room = F.lit(size) - positives.agg(F.count(F.lit(1)).alias("n")).scalar()
    both = positives.unionByName(ranked.where(F.col("__rank") <= room).drop("__rank"))
    return both.orderBy(sample_hash(identity, seed + 1), *identity)


def sort_by(df: DataFrame, *columns) -> DataFrame:
    return df.orderBy(*columns)


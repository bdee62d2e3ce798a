"""Group comparisons: one-way F and pairwise mean differences.

The inputs are metric tables (one row per model and fold).  Group statistics are plain
aggregates over any number of rows; p-values come from a permutation job.

A round of permutations is no sort: rows are numbered once, and a keyed permutation of the numbers, a column
expression, tells to which place a value goes in each round.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.scan import OrderedScan
from punctual.operators.split import SEED
from punctual.session import staged

#: Odd multipliers of the mixing steps, and steps of cycle walking: each finds a number below n with a chance over
#: one half, so none is left after so many.
MULTIPLIERS = (2_654_435_761, 2_246_822_507, 3_266_489_909, 668_265_263)
WALK = 128


def group_stats(df: DataFrame, group: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(n, mean, var) per group, var with n - 1."""
    return df.groupBy(*(keys or []), group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")
    )


def anova_from_stats(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F, both degrees of freedom and the pooled variance from per-group n, mean and var.

    F is null where it is not defined (one group, or no variation within groups).
    """
    keys = keys or []
    n, mean = F.col("n"), F.col("mean")
    sums = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"),
        F.sum(n * mean).alias("s1"), F.sum(n * mean * mean).alias("s2"), F.sum((n - 1) * F.col("var")).alias("within"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    df1, df2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    mse = F.try_divide(F.col("within"), df2)
    f = F.try_divide(F.try_divide(between, df1), mse)
    return sums.select(*keys, df1.alias("df1"), df2.alias("df2"), mse.alias("mse"), f.alias("f_statistic"))


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    return anova_from_stats(group_stats(df, group, value))


def _pairs(stats: DataFrame, mse: Column, group: str, keys: list[str]) -> DataFrame:
    """Ordered pairs of the groups of each key, from one small array per key (one entry per group)."""
    item = F.struct(F.col(group).alias("g"), F.col("n"), F.col("mean"))
    listed = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"), F.first(mse).alias("mse"))
    first = listed.select(*keys, "mse", "all", F.posexplode("all").alias("i", "a"))
    both = first.select(*keys, "mse", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    diff = F.col("b.mean") - F.col("a.mean")
    spread = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return both.select(
        *keys, F.col("a.g").alias("group1"), F.col("b.g").alias("group2"), diff.alias("meandiff"),
        F.try_divide(F.abs(diff), spread).alias("q_statistic"),
    )


def pairwise_mean_diff(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group1, group2, meandiff, q_statistic) with the pooled variance of all groups."""
    stats = group_stats(df, group, value)
    mse = anova_from_stats(stats).select("mse").scalar()
    return _pairs(stats.withColumn("__mse", mse), F.col("__mse"), group, [])


def round_keys(seed: int, rounds: int, turn: Column) -> Column:
    """The keys of a round, 31 bits for each mixing step."""
    draw = lambda r, j: int(hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:8], 16) >> 1
    keys = [[draw(r, j) for j in range(len(MULTIPLIERS))] for r in range(1, rounds + 1)]
    return F.get(F.from_json(F.lit(json.dumps(keys)), "array<array<bigint>>"), turn - 1)


def permuted_place(position: Column, n: int, keys: Column) -> Column:
    """The place, 0 to n - 1, of a position: a permutation for every choice of keys.

    Each mixing step (exclusive or with its key, odd multiplication, folding of the upper half into
    the lower) maps the numbers of n's bits one to one; numbers from n on are mixed again until they
    fall below n.
    """
    if n > 1 << 31:
        raise ValueError("at most 2^31 rows can be dealt")
    bits = max(1, (n - 1).bit_length())
    mask, half = F.lit((1 << bits) - 1).cast("bigint"), max(1, bits // 2)
    factors = F.array(*[F.lit(m & ((1 << bits) - 1) | 1).cast("bigint") for m in MULTIPLIERS])
    folded = lambda x: F.get(F.transform(F.array(x), lambda v: v.bitwiseXOR(F.shiftright(v, half))), F.lit(0))
    step = lambda x, s: folded((x.bitwiseXOR(s["key"].bitwiseAND(mask)) * s["factor"]).bitwiseAND(mask))
    mix = lambda x: F.aggregate(F.arrays_zip(keys.alias("key"), factors.alias("factor")), x, step)
    walk = F.sequence(F.lit(0), F.lit(WALK))
    return F.aggregate(walk, position.cast("bigint"), lambda x, i: F.when((i > 0) & (x < n), x).otherwise(mix(x)))


def permuted(df: DataFrame, group: str, value: str, identity: list[str], rounds: int, seed: int = SEED) -> DataFrame:
    """Rows (round, group, value): the metric table ``rounds`` times with its values dealt anew to the groups.

    The rows are numbered in the order of their identity.  In each round the value at a position goes to
    the group at its permuted place, a join on the place: no task holds a whole round.
    """
    base = df.select(*identity, *[c for c in (group, value) if c not in identity]).where(F.col(value).isNotNull())
    numbered = staged(OrderedScan(staged(base), [], identity).prior_count("position").result().select("position", group, value))
    n = numbered.count()
    drawn = numbered.select("position", value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = drawn.withColumn("keys", round_keys(seed, rounds, F.col("round")))
    dealt = drawn.select("round", value, permuted_place(F.col("position"), n, F.col("keys")).alias("place"))
    return dealt.join(numbered.select(F.col("position").alias("place"), group), "place").drop("place")


def significance(
    df: DataFrame, group: str, value: str, identity: list[str], rounds: int = 999, alpha: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """(F test, pairwise table) with permutation p-values.

    The pairwise p is adjusted for all pairs: how often the largest q of a round reaches the
    pair's q.
    """
    shuffled = permuted(df, group, value, identity, rounds)
    # one row for each round and group
    stats = staged(group_stats(shuffled, group, value, ["round"]))
    tests = anova_from_stats(stats, ["round"])
    observed = anova_oneway(df, group, value)
    share = lambda hits: (hits + 1) / F.lit(rounds + 1)
    beaten = tests.where(F.col("f_statistic") >= observed.select("f_statistic").scalar() - 1e-12)
    test = observed.withColumn("p_value", share(beaten.agg(F.count(F.lit(1)).alias("n")).scalar()))

    with_mse = stats.join(tests.select("round", F.col("mse").alias("__mse")), "round")
    largest = _pairs(with_mse, F.col("__mse"), group, ["round"]).groupBy("round").agg(F.max("q_statistic").alias("q"))
    # one sorted array of ``rounds`` numbers
    array = largest.agg(F.sort_array(F.collect_list("q")).alias("qs")).scalar()
    pairs = pairwise_mean_diff(df, group, value).withColumn("__qs", array)
    q = F.col("q_statistic")
    pairs = pairs.withColumn("p_adj", share(F.size(F.filter("__qs", lambda x: x >= q - 1e-12))))
    return test, pairs.withColumn("reject", F.col("p_adj") < alpha).drop("__qs")

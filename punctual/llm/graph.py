"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.session import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node that each linked node is connected with.

    Large-star and small-star steps in turn: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows, until all hang on their smallest directly.  Links are
    written once a round and only counts come to the driver.  A node with very many links is split
    by the partial aggregates and by adaptive joins.  Self-links, nulls and repeats are harmless;
    no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    # always from the larger to the smaller node
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: larger neighbours of a node go to its smallest
        star = links.select(F.col("b").alias("a"), F.col("a").alias("x")).join(least, "a").select(F.col("x").alias("a"), F.col("low").alias("b"))
        star = staged(star.distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = star.groupBy("a").agg(F.min("b").alias("low"))
        joined = star.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(joined.select("a", F.col("low").alias("b")))
        new = staged(small.where("a <> b").distinct())
        # done when every link ends in a node that links nowhere itself, and no node has two
        roots = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        twice = new.groupBy("a").count().where("count > 1").limit(1).count()
        links = new
        if not roots and not twice:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )

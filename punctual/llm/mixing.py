"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.session import staged

#: Points of the golden-ratio sequence are i * STEP modulo RANGE.
RANGE = 1 << 31
STEP = 1_327_217_885
#: The range is also cut into equal cells, by which a point finds the few sources it can fall into.
CELL = 1 << 19
#: Points that are ranked together, and buckets of the shuffled order within a source.
CHUNK = 8192
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def place_of(doc_id: Column, text: Column) -> Column:
    """Place in the shuffle, 60 bits: rows equal in id and text share it."""
    digest = F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, place): words of each document and its place in the shuffle."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        place_of(F.col(doc_id), F.col(text)).alias("place"),
    )


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources stand by code point, null last, and weigh ``weights`` in turn.  ``share`` of all sizes
    is dealt by weight; a target stops at ``most`` times its source's size and the excess is dealt
    again by weight among the others, until none is above.  That ends at the level L with
    sum(min(most * size, weight * L)) = total, found in one pass over the sources in the order in
    which they fill up.  The windows hold one row for each source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("n", number).withColumn(
        "w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights)).cast("int"))
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything, by_level = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "n")
    w = w.withColumns({
        "total": F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything)),
        "filled": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    # the first source in that order that stays below its cap fixes the level for the rest
    stays = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "n", "level"))
    target = F.least("cap", F.coalesce(F.min(stays).over(everything)["level"] * F.col("w"), F.col("cap")))
    return w.select("source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots (slot, source, rank, block_no, words) in the order of the mix.

    Point i of the golden-ratio sequence falls into the cumulative shares of the targets, which
    names the slot's source; slots are ranked within their source.  The slot of rank r takes the
    first ``words`` words of block ``block_no``: the blocks of a source in turn, beginning again
    after the last, until its target is reached.  ``slot`` is the number of the point; points
    that come after their source has reached its target are left out.

    Ranks are counted per chunk of points and summed up over chunks, so that the slots of a hot
    source are ranked by many tasks.
    """
    spark = targets.sparkSession
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    t = targets.withColumn("goal", F.round("target").cast("bigint")).where("goal > 0")
    # every source has a unit of the range at least, the rest goes by slots
    t = t.withColumn("turns", F.ceil(F.col("goal") / block))
    part = F.sum("turns").over(by_source) / F.sum("turns").over(everything) * (F.lit(RANGE) - F.count("*").over(everything))
    t = t.withColumn("upto", F.round(part).cast("bigint") + F.row_number().over(by_source))
    t = t.withColumn("since", F.coalesce(F.lag("upto").over(by_source), F.lit(0).cast("bigint")))
    # the sequence strays from its shares by less than log2(n) + 3 points: so many more are drawn
    slots = F.col("turns") + F.log2(F.sum("turns").over(everything) + 2) + 3
    t = t.withColumn("points", F.ceil(slots * RANGE / (F.col("upto") - F.col("since"))))
    points = t.agg(F.max("points")).first()[0] or 0
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") / CELL), F.floor((F.col("upto") - 1) / CELL))))
    point = spark.range(points).withColumn("at", (F.col("id") % RANGE) * STEP % RANGE)
    # at most RANGE / CELL rows more than there are sources; adaptive execution picks the join by size
    fallen = point.withColumn("cell", F.floor(F.col("at") / CELL)).join(cells, "cell").where("at >= since and at < upto").select(
        F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), "source", "source_size", "goal"
    )
    per_chunk = fallen.groupBy("source", "chunk").count()
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("carried")
    )
    here = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))
    ranked = fallen.withColumn("here", here).join(carried, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.withColumn("rank", F.col("here") + F.col("carried") - 1)
    blocks = F.ceil(F.col("source_size") / block)
    ranked = ranked.withColumn("round", F.floor(F.col("rank") / blocks)).withColumn("block_no", F.col("rank") - F.col("round") * blocks)
    first = F.col("block_no") * block
    words = F.least(F.lit(block), F.col("source_size") - first, F.col("goal") - F.col("round") * F.col("source_size") - first)
    return ranked.withColumn("words", words.cast("bigint")).where("words > 0").select("slot", "source", "rank", "block_no", "words")


def positions(rows: DataFrame) -> DataFrame:
    """Add ``start``: words of the same source that stand before the document in the shuffle.

    Sums are taken per bucket of the shuffled order and carried over the buckets, so a hot source
    is spread over many tasks.
    """
    b = rows.withColumn("bucket", F.shiftright("place", 48).cast("int"))
    per_bucket = b.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("carried")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b = b.join(carried, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return b.withColumn("start", F.col("inside") + F.col("carried")).drop("s", "b", "bucket", "inside", "carried")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block: int = 512,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, place, size, source_size, target, taken, slots), one for each document.

    ``taken`` is the number of the document's words that the mix takes, repeats counted; per
    source they add up to its target, rounded.  The words of a source, documents in shuffled
    order, are cut into blocks of ``block`` words, which the slots of ``schedule`` take; ``slots`` are
    the numbers of those that take words of the document, in the order of the mix, empty if none does.

    A null text, or one without words, has size 0 and nothing is taken from it.  Null sources form
    one source of their own, the last.  Repeated rows each count; rows equal in id and text are
    interchangeable.  An empty table gives an empty result; other columns are not read.
    """
    rows = staged(measured(docs, doc_id, text, source))
    targets = staged(source_targets(rows, weights, share, most))
    slots = schedule(targets, block).groupBy(F.col("source").alias("s"), F.col("block_no").alias("b")).agg(
        F.collect_list(F.struct("slot", "words")).alias("takes")  # one for each round: at most ``most`` and one more
    )
    placed = positions(rows.where("size > 0")).withColumn("end", F.col("start") + F.col("size"))
    last = F.floor((F.col("end") - 1) / block)
    cut = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    lo = F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0))
    hi = F.least(F.col("end") - F.col("block_no") * block, F.lit(block))
    cut = cut.withColumns({"lo": lo, "hi": hi})
    joined = cut.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block_no") == F.col("b")), "left")
    got = F.transform(
        F.coalesce("takes", F.array().cast("array<struct<slot:bigint,words:bigint>>")),
        lambda take: F.struct(take["slot"].alias("slot"), (F.least(take["words"], F.col("hi")) - F.col("lo")).alias("words")),
    )
    got = F.filter(got, lambda piece: piece["words"] > 0)
    part = F.aggregate(got["words"], F.lit(0).cast("bigint"), lambda total, words: total + words)
    taken = joined.withColumns({"part": part, "by": got["slot"]}).groupBy("doc_id", "source", "place", "size", "start").agg(
        F.sum("part").alias("taken"), F.array_sort(F.flatten(F.collect_list("by"))).alias("slots")
    )
    # rows without words share their start, so they stay out of the grouping
    none = rows.where("size = 0").select(
        "doc_id", "source", "place", "size", F.lit(0).cast("bigint").alias("taken"), F.array().cast("array<bigint>").alias("slots")
    )
    taken = taken.select("doc_id", "source", "place", "size", "taken", "slots").union(none)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return taken.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "place", "size", "source_size", "target", "taken", "slots"
    )

"""Merkle manifest of a dataset: one tree of hashes for each group of rows, one over the groups.

The nodes of a tree are numbered, and every FAN consecutive ones make their parent.  A pass takes blocks of
FAN ** LEVELS consecutive nodes, so no run is cut and a hot group falls into many tasks.  Inside a
block a node of level l stands on the row of its first leaf, so its siblings are the rows
FAN**l, 2 * FAN**l, ... places before and after: per level fixed-offset lag and lead columns,
masked by the node's slot, and by the run's length through the end of the block.  First-child rows
hash the parents.  All levels of a pass share one shuffle and one sort; the roots of the blocks are
the nodes of the next pass.  Top down, each block learns the path above it by a join on the block,
which the rows are already dealt by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.scan import OrderedScan
from punctual.session import staged

FAN = 3
LEVELS = 6


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """SHA-256, in lowercase hex, of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[encoded(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    """The siblings on a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _climb(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Add ``block``, ``path`` (siblings inside the block) and ``top`` (its root) to nodes (tree, pos, h, ..)."""
    size = fan**levels
    out = nodes.withColumns({"block": F.floor(F.col("pos") / size).cast("long"), "__q": (F.col("pos") % size).cast("int")})
    block = Window.partitionBy("tree", "block")
    w = block.orderBy("pos")
    # a block that is not full is either the last of several or the whole tree
    count = F.count(F.lit(1)).over(block)
    own = sum((F.when(count > fan**level, 1).otherwise(0) for level in range(levels)), F.lit(0))
    out = out.withColumn("__depth", F.when((F.col("block") > 0), levels).otherwise(own)).withColumn("__h", F.col("h"))
    for level in range(levels):
        step, q = fan**level, F.col("__q")
        around = {f"__b{i}": F.lag("__h", i * step).over(w) for i in range(1, fan)}
        around |= {f"__a{i}": F.lead("__h", i * step).over(w) for i in range(1, fan)}
        out = out.withColumns(around)
        slot = F.floor(q / step) % fan
        node = (q % step == 0) & (F.col("__depth") > level)
        # the run holds slots 0 to fan - 1: i places back for slots from i on, i places ahead for slots below fan - i
        before = F.concat(*[F.when(slot >= i, F.coalesce(f"__b{i}", F.lit(""))).otherwise("") for i in range(fan - 1, 0, -1)])
        after = F.concat(*[F.when(slot < fan - i, F.coalesce(f"__a{i}", F.lit(""))).otherwise("") for i in range(1, fan)])
        out = out.withColumn(f"__p{level}", F.when(node, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(node, digest(F.col("__h"), F.col(f"__p{level}.after"))).otherwise(F.col("__h"))
        out = out.withColumn("__h", F.when(q % (step * fan) == 0, parent)).drop(*around)
    # a node's row comes before those of all leaves below it and after those of its elder siblings
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = {f"__p{level}": F.last(f"__p{level}", ignorenulls=True).over(upto) for level in range(levels)}
    out = out.withColumns(steps | {"top": F.first("__h").over(upto)})
    path = F.filter(F.array(*[F.col(f"__p{level}") for level in range(levels)]), lambda p: p.isNotNull())
    return out.withColumn("path", path).drop("__q", "__depth", "__h", *steps)


def trees(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS, over=None) -> DataFrame:
    """Nodes (tree, pos, h, ..) with ``top``, the root of their tree, and ``path``, their siblings on the way up.

    ``pos`` numbers the nodes of a tree from 0 without gaps.  ``over`` maps the roots (tree, h) to rows
    (tree, path, ..) of what comes above them: its path is appended, its other columns are added.
    """
    last = nodes.agg(F.max("pos")).first()[0] or 0
    passes = [nodes]
    while last >= fan**levels:
        climbed = _climb(passes[-1], fan, levels)
        roots = climbed.where(F.col("pos") % fan**levels == 0)
        passes.append(staged(roots.select("tree", F.col("block").alias("pos"), F.col("top").alias("h"))))
        last //= fan**levels
    # here every tree is a single block, so no key of these joins has more rows than a block
    out = _climb(passes.pop(), fan, levels).drop("block")
    more = []
    if over is not None:
        above = over(staged(out.where("pos = 0").select("tree", F.col("top").alias("h"))))
        more = [c for c in above.columns if c not in ("tree", "path")]
        above = above.withColumnRenamed("path", "__up")
        out = out.join(above, "tree").withColumn("path", F.concat("path", "__up")).drop("__up")
    while passes:
        above = out.select("tree", F.col("pos").alias("block"), F.col("path").alias("__up"), F.col("top").alias("__top"), *more)
        out = _climb(passes.pop(), fan, levels).join(above, ["tree", "block"])
        out = out.withColumns({"path": F.concat("path", "__up"), "top": F.col("__top")}).drop("__up", "__top", "block")
    return out


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fan: int = FAN,
    levels: int = LEVELS,
) -> DataFrame:
    """One row for each row of ``docs``: ``order``, the ``carry`` columns, leaf, subroot, root and path.

    A leaf is the digest of the encoded fields.  In each group leaves stand in ascending order, and
    ``subroot`` is the root of their tree; the subroots stand in the order of the groups (null first, then by
    UTF-8 bytes) under ``root``.  ``path`` holds for each level, from the leaf to the root, the sibling digests
    before and after the node; ``fold`` and ``proof`` read it.

    Nulls are values of their own: a null group is a group, rows with a null in ``order`` come first.  Rows
    that repeat the order value stand in the order of their digests, equal rows one after the other, each
    a leaf.  Texts are hashed whole where they are read and travel no further.  Columns of other names are
    not read, whatever they are called.  An empty table gives an empty result.
    """
    carry = carry or {}
    leaves = docs.select(
        F.col(order).alias("__at"), encoded(F.col(group)).alias("tree"), leaf_of([F.col(f) for f in fields]).alias("h"),
        *[c.alias(f"__carry_{n}") for n, c in carry.items()],
    )
    # the place in the written table tells equal rows apart, so that many of them share the work
    written = staged(leaves).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    numbered = OrderedScan(written, ["tree"], ["__at", "h", "__file", "__row"]).prior_count("pos").result()
    numbered = staged(numbered.drop("__file", "__row"))

    def roots(tops: DataFrame) -> DataFrame:
        name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
        named = tops.select(F.col("tree").alias("__group"), F.lit("").alias("tree"), "h", name.alias("__name"))
        placed = OrderedScan(named, [], ["__name"]).prior_count("pos").result().drop("__name")
        return trees(staged(placed), fan, levels).select(
            F.col("__group").alias("tree"), "path", F.col("h").alias("subroot"), F.col("top").alias("root")
        )

    done = trees(numbered, fan, levels, roots)
    return done.select(
        F.col("__at").alias(order), *[F.col(f"__carry_{n}").alias(n) for n in carry], F.col("h").alias("leaf"), "subroot", "root", "path"
    )

"""Set-similarity join of documents through count vectors in R-trees.

A document is the set of its distinct word n-grams.  Two sets link if their intersection is at
least ``threshold`` of their union.

Each set is hashed into GROUPS groups; the counts of the groups make it a point, and the sum of the
smaller counts of two points, coordinate by coordinate, bounds their overlap from above.  Points
stand in a forest of R-trees.  A tree holds the points that agree in one block of tokens: within a
size class the tokens are dealt into blocks small enough that two linked sets have each block whole
in common with probability a half, and every set goes to the trees of its first TREES blocks of at
least two tokens (of several dealings, if the set is small).  So two linked sets miss each other in
all trees with a probability of about 2**-TREES, and sets that merely share a passage or a frequent
word seldom meet.  Inside a tree, boxes of points are passed over by the same bound.

Surviving pairs are verified on the sets.  The join then needs links only between different
components: a first round proposes, per tree, a forest of the most similar survivors; a second round
verifies every surviving pair that the first left in different components.  A large group of
near copies therefore never gives its square of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import per_row
from punctual.llm.graph import components
from punctual.llm.hashing import as_bytes, mix, shingles, word_hashes
from punctual.llm.prune import marked
from punctual.session import staged

#: Trees that each set stands in, groups of a count vector, points of a tree's leaf, and points that
#: one task compares at once (more points of a tree are compared block against block).
TREES = 32
GROUPS = 128
LEAF = 32
TASK_POINTS = 1024
FULL = 255

SKETCH = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
    T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType()),
])


def size_classes(n: int, threshold: float) -> list[int]:
    """Classes k, of sizes (2**k, 2**(k+1)], in which a set of n tokens can have a partner.

    A set looks in its own class and, if a partner may be that large, in the next; so two linked
    sets always share one.
    """
    own = max(0, math.ceil(math.log2(n)) - 1) if n > 1 else 0
    return [own] if n / threshold < (2 << own) + 1 else [own, own + 1]


def tokens_in_block(threshold: float) -> float:
    """Tokens of a block that two sets at the threshold have in common with probability a half."""
    return math.log(0.5) / math.log(threshold)


def cells(tokens: np.ndarray, threshold: float) -> list[int]:
    """Keys of the trees that a set stands in."""
    out: list[int] = []
    for k in size_classes(len(tokens), threshold):
        blocks = max(2, round((1.5 * (1 << k)) / tokens_in_block(threshold)))
        here: list[np.ndarray] = []
        count = 0
        for deal in range(1, 9):  # small sets: dealt anew until there are enough blocks
            dealt = mix(tokens, 1000 * k + deal)
            block = (dealt >> np.uint64(33)) % np.uint64(blocks)
            if blocks > 4 * TREES:
                near = block < np.uint64(4 * TREES)
                dealt, block = dealt[near], block[near]
            order = np.argsort(block, kind="stable")
            block, dealt = block[order], dealt[order]
            starts = np.flatnonzero(np.diff(block, prepend=np.uint64(1 << 63)))
            if not len(starts):
                continue
            sums = np.add.reduceat(mix(dealt, 5), starts)
            sizes = np.diff(np.append(starts, len(block)))
            full = sizes >= 2
            place = (block[starts] << np.uint64(16)) + np.uint64(k * 64 + deal)
            keys = mix(sums[full] ^ mix(place[full], 11))[: TREES - count]
            here.append(keys)
            count += len(keys)
            if count >= TREES:
                break
        if count == 0:  # no block of two tokens: the set as a whole, in a tree of its size
            here.append(mix(np.array([tokens.sum()], np.uint64), k))
        out.extend(np.concatenate(here).view(np.int64).tolist())
    return out


def point(tokens: np.ndarray) -> bytes:
    """Counts of the groups, a byte each; 255 or more is taken as any number, so the bound stays one."""
    counts = np.bincount((mix(tokens, 77) >> np.uint64(50)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def sketcher(ngram: int, threshold: float):
    def sketch(text: str | None):
        tokens = shingles(word_hashes(as_bytes(text)), ngram)
        if not len(tokens):
            return 0, None, None, None, None
        sums = [int(x) for x in np.array([mix(tokens, 21).sum(), mix(tokens, 22).sum()], np.uint64).view(np.int64)]
        return len(tokens), *sums, cells(tokens, threshold), point(tokens)

    return sketch


def needed(a: np.ndarray, b: np.ndarray | int, threshold: float) -> np.ndarray:
    """Least overlap of linked sets of a and b tokens."""
    return np.ceil((a + b) * (threshold / (1 + threshold)) - 1e-6)


def tree_pairs(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (left, right) whose points allow the overlap, with the bound over what is needed.

    The right points are bulk-loaded into leaves by size, then by their first group; a leaf's box is
    the largest count in each group and its least size.
    """
    order = np.lexsort((right[:, 0], right_n))
    for at in range(0, len(order), LEAF):
        leaf = order[at : at + LEAF]
        top, small, large = right[leaf].max(axis=0), right_n[leaf].min(), right_n[leaf].max()
        near = np.flatnonzero((left_n >= threshold * small - 1e-6) & (threshold * left_n - 1e-6 <= large))
        if not len(near):
            continue
        box = np.minimum(left[near], top).sum(axis=1, dtype=np.int64)
        near = near[(box >= needed(left_n[near], small, threshold)) | (left[near] == FULL).any(axis=1)]
        for j in leaf:
            shared = np.minimum(left[near], right[j]).sum(axis=1, dtype=np.int64)
            need = needed(left_n[near], right_n[j], threshold)
            over = (shared >= need) | (left[near] == FULL).any(axis=1)
            yield near[over], np.full(int(over.sum()), j), (shared - need)[over]


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _search(threshold: float, forest: bool):
    """Task over the points of a tree, or of two blocks of a tree."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rid, comp, n, block = (table.column(c).to_numpy() for c in ("rid", "comp", "n", "block"))
        points = np.stack([np.frombuffer(p.as_py(), np.uint8) for p in table.column("point")])
        mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b, found_by = [], [], []
        for a, b, by in tree_pairs(points[mine], n[mine], points[other], n[other], threshold):
            a, b = mine[a], other[b]
            keep = comp[a] != comp[b]
            if i == j:
                keep &= rid[a] < rid[b]
            found_a.append(a[keep])
            found_b.append(b[keep])
            found_by.append(by[keep])
        a, b, by = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b, found_by))
        if forest and len(a):
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            chosen = []
            for k in np.argsort(-by, kind="stable"):
                x, y = root(comp[a[k]]), root(comp[b[k]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    chosen.append(k)
            a, b = a[chosen], b[chosen]
        return pa.table({"a": np.minimum(rid[a], rid[b]), "b": np.maximum(rid[a], rid[b])}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _candidates(members: DataFrame, points: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) of different components that survive in some tree."""
    trees = members.groupBy("cell").agg(F.count("*").alias("points"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
    m = members.join(trees.select("cell", "points"), "cell").withColumn("blocks", F.ceil(F.col("points") / TASK_POINTS).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    m = m.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    m = m.join(points, "rid").select("cell", "i", "j", "block", "rid", "comp", "n", "point")
    return m.groupBy("cell", "i", "j").applyInArrow(_search(threshold, forest), PAIR).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """The pairs whose sets link, decided on the sets themselves."""
    pairs = staged(pairs)
    wanted = staged(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct())
    fields = T.StructType([T.StructField("tokens", T.BinaryType())])
    texts = marked(docs, [F.col("doc_id")], wanted).where("__maybe").join(wanted, F.col("doc_id") == F.col("rid"))
    sets = per_row(texts, ["text"], fields, lambda t: (shingles(word_hashes(as_bytes(t)), ngram).tobytes(),), ["rid"])
    # repeated rows of a document: one is enough
    sets = sets.withColumn("h", F.xxhash64("tokens")).dropDuplicates(["rid", "h"]).drop("h")
    sets = staged(sets.where(F.length("tokens") > 0))
    joined = pairs.join(sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb")), "b"
    )

    def linked(ta: bytes, tb: bytes):
        x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (round(threshold * 1000) * (len(x) + len(y) - both) <= 1000 * both,)

    kept = per_row(joined, ["ta", "tb"], T.StructType([T.StructField("linked", T.BooleanType())]), linked, ["a", "b"])
    return staged(kept.where("linked").select("a", "b").distinct())


def join(
    docs: DataFrame, ngram: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents with their component, and the links found.

    The first frame has one row for each input row: doc_id, n_shingles, class_id (smallest doc_id
    with the same set) and component_id (smallest doc_id reachable by links, its own included).
    The second has links (a, b) between class ids, enough to connect every component.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, of the whole text; with fewer words than
    ``ngram`` the sequence as a whole is the only shingle.  A text that is null or has no word has
    an empty set and links with nothing; a null doc_id takes no part and has null ids.  Rows that
    repeat a doc_id are the same document.  Empty tables give empty results; other columns are not
    read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = staged(per_row(docs, ["text"], SKETCH, sketcher(ngram, threshold), ["doc_id"]))
    known = sketches.where("doc_id is not null and n > 0")
    # equal sets are one class, whatever their number
    classes = staged(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rid")))
    heads = known.join(classes.select("f1", "f2", F.col("n").alias("cn"), "rid"), ["f1", "f2"]).where("n = cn and doc_id = rid")
    heads = staged(heads.select("rid", "n", "point", "cells").dropDuplicates(["rid", "n"]))
    places = heads.select("rid", F.explode("cells").alias("cell"))
    # trees with the same members give the same pairs: one of them is searched
    trees = places.groupBy("cell").agg(
        F.min("rid").alias("r1"), F.max("rid").alias("r2"), F.count("*").alias("points"), F.bit_xor(F.xxhash64("rid")).alias("who")
    ).where("r1 <> r2")
    shared = trees.groupBy("r1", "r2", "points", "who").agg(F.min("cell").alias("cell")).select("cell")
    placed = staged(places.join(shared, "cell"))
    points = staged(heads.join(placed.select("rid").distinct(), "rid").select("rid", "n", "point"))
    members = placed.withColumn("comp", F.col("rid"))
    links = _verified(_candidates(members, points, threshold, forest=True), docs, ngram, threshold)
    of = components(links).withColumnRenamed("node", "rid")
    members = placed.join(of, "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
    more = _verified(_candidates(members, points, threshold, forest=False), docs, ngram, threshold)
    links = staged(links.union(more))
    # a doc_id that stands in two classes (rows with different texts) connects them
    same = known.join(classes.select("f1", "f2", F.col("n").alias("cn"), "rid"), ["f1", "f2"]).where("n = cn")
    same = staged(same.select("doc_id", "rid").distinct())
    torn = same.join(same.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id")
    of = components(links.union(torn.select("doc_id", "rid")))
    named = sketches.select("doc_id", "n", "f1", "f2").join(
        classes.select("f1", "f2", F.col("n"), "rid"), ["f1", "f2", "n"], "left"
    )
    named = named.join(of.select(F.col("node").alias("rid"), "component"), "rid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("rid", "doc_id"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", own)).alias("component_id"),
    ), links

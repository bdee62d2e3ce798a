"""Approximate nearest neighbours by inner product: p-stable hashing with many probes.

Vectors are scaled by the largest norm and get one more coordinate that makes them unit vectors, so
the largest inner product is the least distance.  A table hashes a vector by HASHES random
projections, each cut into cells of WIDTH.  A query visits, in every table, the PROBES buckets
that most likely hold a neighbour: the chance that a neighbour at distance REACH falls into a cell is
known from the query's place in its own cell, and the buckets are visited in the order of the
product.  What the tables find is merged and ranked by the exact inner product.

Equal vectors are one entry of the index that carries their smallest ids, so a vector with very many
copies takes one place.  Full buckets are compared in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.session import staged

TABLES = 4
HASHES = 3
WIDTH = 1.5
PROBES = 12
REACH = 1.2
SEED = 20_231
#: Vectors and queries that one task compares at once.
BLOCK = 4096


def projections(dim: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Random directions (tables, dim + 1, hashes) and shifts (tables, hashes)."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((tables, dim + 1, hashes)), rng.uniform(0, width, (tables, hashes))


def bucket_keys(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One number for the cells of a bucket, its table and the dimension of its vectors."""
    key = np.full(len(cells), (dim * 1_000_003 + table) * 7919, np.int64)
    for k in range(cells.shape[1]):
        key = key * 1_000_003 + cells[:, k]
    return key


def probe_order(place: np.ndarray, probes: int | None) -> np.ndarray:
    """Cells of the buckets to visit, likeliest first; all that unit vectors can reach if None.

    ``place`` is the projected query in units of cells; the chances of the cells are independent.
    """
    own = np.floor(place).astype(np.int64)
    if probes is None:
        return own + np.array(list(itertools.product(range(-14, 15), repeat=len(place))))
    steps = np.arange(-3, 4)
    edge = (own[:, None] + steps - place[:, None]) * WIDTH / REACH
    normal = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    logs = np.log(normal(edge + WIDTH / REACH) - normal(edge) + 1e-12)
    total, cells = np.zeros(1), np.zeros((1, 0), np.int64)
    for k in range(len(place)):
        total = (total[:, None] + logs[k]).ravel()
        cells = np.hstack([np.repeat(cells, len(steps), 0), np.tile(own[k] + steps, len(cells))[:, None]])
    return cells[np.argsort(-total, kind="stable")[:probes]]


VECTOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("norm", T.DoubleType())])


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles."""
    for batch in batches:
        rows = []
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = values.as_py()
            if i is None or not v or any(x is None for x in v):
                continue
            v = np.array(v, np.float64)
            norm = float(np.sqrt(v @ v))
            if np.isfinite(v).all() and 0 < norm < math.inf:
                rows.append((i, (v + 0.0).tobytes(), norm))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.float64())],
            names=["id", "vec", "norm"],
        )


def _placed(largest: float, probing: bool, every: bool = False):
    """Rows (bucket, cid, vec): the buckets of an entry, or those that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            cids, vecs = batch.column("cid").to_pylist(), batch.column("vec").to_pylist()
            for at in range(0, len(cids), 256):
                keys, who, data = [], [], []
                for cid, raw in zip(cids[at : at + 256], vecs[at : at + 256], strict=True):
                    v = np.frombuffer(raw, np.float64)
                    directions, shifts = known.setdefault(len(v), projections(len(v)))
                    if probing:
                        unit = np.append(v / np.sqrt(v @ v), 0.0)
                    else:
                        v = v / largest
                        unit = np.append(v, math.sqrt(max(0.0, 1 - v @ v)))
                    for t in range(1 if every else TABLES):
                        place = (unit @ directions[t] + shifts[t]) / WIDTH
                        cells = probe_order(place, None if every else PROBES) if probing else np.floor(place).astype(np.int64)[None, :]
                        got = bucket_keys(cells, t, len(unit) - 1)
                        keys.append(got)
                        who.extend([cid] * len(got))
                        data.extend([raw] * len(got))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys), pa.int64()), pa.array(who, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "cid", "vec"]
                )

    return run


PLACED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("vec", T.BinaryType())])
FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("score", T.DoubleType())])


def _compare(k: int):
    """Task over one block of entries and one of queries of a bucket: the k + 1 best for each query."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        x = np.stack([np.frombuffer(v.as_py(), np.float64) for v in entries.column("vec")])
        ids, asked = entries.column("cid").to_numpy(), queries.column("cid").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        out = []
        for at in range(0, len(asked), 512):
            q = np.stack([np.frombuffer(v.as_py(), np.float64) for v in queries.column("vec")[at : at + 512]])
            scores = q @ x.T
            if scores.shape[1] > k + 1:
                # every entry at or above the (k + 1)-th score, then by score and id
                floor = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1]
                row, col = np.nonzero(scores >= floor[:, None])
            else:
                row, col = np.nonzero(np.ones(scores.shape, bool))
            value = scores[row, col]
            best = np.lexsort((col, -value, row))
            row, col, value = row[best], col[best], value[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
            top = rank <= k
            out.append(pa.table({"q": asked[at + row[top]], "cid": ids[col[top]], "score": value[top]}, schema=schema))
        return pa.concat_tables(out)

    return run


def _found(entries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The best entries of every visited bucket, rows (q, cid, score), some of them twice."""
    full = entries.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    asked = probes.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"))
    blocks = full.join(asked, "bucket")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entries.join(blocks, "bucket").withColumn("row", F.pmod(F.xxhash64("cid"), F.col("rows")).cast("int")).withColumn("col", numbers("cols"))
    right = probes.join(blocks, "bucket").withColumn("col", F.pmod(F.xxhash64("cid"), F.col("cols")).cast("int")).withColumn("row", numbers("rows"))
    keys = ["bucket", "row", "col"]
    return left.select(*keys, "cid", "vec").groupBy(*keys).cogroup(right.select(*keys, "cid", "vec").groupBy(*keys)).applyInArrow(_compare(k), FOUND)


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows found for each query row.

    ``is_query`` is a condition on the ids; a query's own row is no candidate for it.  Scores are
    inner products of the original vectors in double precision, ranks go by score and then by the
    smaller id.  If the probes of a query find fewer than k candidates, all buckets are visited for it.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id; vectors of different length never meet.  Rows that repeat id and vector are one.
    Empty tables give an empty result; other columns are not read.
    """
    source = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"))
    rows = source.mapInArrow(_valid, VECTOR).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    rows = staged(rows.dropDuplicates(["id", "h1", "h2"]))
    largest = rows.agg(F.max("norm")).first()[0] or 1.0
    # equal vectors: the k + 1 smallest ids, taken in shares first so that no copy gathers in one task
    share = F.pmod(F.xxhash64("id"), F.lit(256))
    low = F.row_number().over(Window.partitionBy("h1", "h2", "share").orderBy("id"))
    few = rows.withColumn("share", share).withColumn("n", low).where(F.col("n") <= k + 1)
    entries = staged(few.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"), F.first("vec").alias("vec")))
    asked = staged(rows.where(is_query).select("id", "h1", "h2").join(entries.select("h1", "h2", "cid"), ["h1", "h2"]).select("id", "cid"))
    queries = entries.join(asked.select("cid").distinct(), "cid").select("cid", "vec")
    placed = staged(entries.select("cid", "vec").repartition("cid").mapInArrow(_placed(largest, probing=False), PLACED))
    probes = staged(queries.repartition("cid").mapInArrow(_placed(largest, probing=True), PLACED))
    first = _nearest(_found(placed, probes, k), entries, k)
    first = staged(first)
    short = queries.join(first.where(F.size("near") >= k + 1).select(F.col("q").alias("cid")), "cid", "left_anti")
    if short.limit(1).count():
        every = staged(short.repartition("cid").mapInArrow(_placed(largest, probing=True, every=True), PLACED))
        again = staged(_nearest(_found(placed, every, k), entries, k))
        first = first.join(again.select("q"), "q", "left_anti").union(again)
    own = asked.join(first, F.col("cid") == F.col("q")).select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near")
    )
    ranked = own.select("query_id", F.posexplode("near").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _nearest(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Rows (q, near): the k + 1 best ids of each query as structs (minus, id), best first."""
    one = found.groupBy("q", "cid").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    best = one.withColumn("n", rank).where(F.col("n") <= k + 1)
    ids = best.join(entries.select("cid", "ids"), "cid").select("q", F.explode("ids").alias("id"), (-F.col("score")).alias("minus"))
    # at most (k + 1) squared rows a query
    return ids.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "id"))), 1, k + 1).alias("near"))

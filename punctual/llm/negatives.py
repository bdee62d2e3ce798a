"""Hard negatives by exact integer scores: a matrix product in residue numbers, then windows.

Components become integers.  An inner product of integers is computed modulo several small primes: the
residues, between -p/2 and p/2, are multiplied as float32 matrices, and the partial sums stay
below 2^24, so each product is exact.  Signed mixed-radix digits (Chinese remaindering)
give back the score itself.  As many primes are taken as the largest norms ask for.

Anchors come in blocks of ANCHORS and rows in groups of about ROWS; a task multiplies one block with one group
and keeps, for each anchor, what can be among the first few.  Up to ANCHORS anchors every row is
shipped once; windows over what the tasks kept choose positives and then negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.session import staged

#: Anchors and rows that one task multiplies, and rows of a single matrix product.
ANCHORS = 4096
ROWS = 16_384
CHUNK = 1024
#: Dimensions of one float32 product: (p / 2)^2 * INNER stays below 2^24 for primes below LARGEST.
INNER = 256
LARGEST = 512


def primes(bound: int, largest: int = LARGEST) -> list[int]:
    """Odd primes below ``largest``, greatest first, whose product exceeds 2 * bound + 1."""
    found, product = [], 1
    for p in range(largest - 1, 2, -1):
        if product > 2 * bound + 1:
            break
        if p % 2 and all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
    if product <= 2 * bound + 1:
        raise ValueError("components are too large for the primes at hand")
    return found


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Integers (as doubles) modulo an odd prime, between -(p - 1) / 2 and (p - 1) / 2, in float32."""
    r = np.fmod(values, p)
    r = np.where(r > (p - 1) // 2, r - p, r)
    return np.where(r < -((p - 1) // 2), r + p, r).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact a @ b.T of integer matrices (as doubles), as int64."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        half = (p - 1) // 2
        ra, rb = residues(a, p), residues(b, p)
        total = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], INNER):
            total += (ra[:, at : at + INNER] @ rb[:, at : at + INNER].T).astype(np.int64)
        # mixed radix: what is left after the digits so far, divided by their primes
        for q, d in zip(moduli[:i], digits, strict=True):
            total = (total - d) % p * pow(q, -1, p)
        total %= p
        digits.append(np.where(total > half, total - p, total))
    score, radix = np.zeros((len(a), len(b)), np.int64), 1
    with np.errstate(over="ignore"):
        for p, d in zip(moduli, digits, strict=True):
            score += d * np.int64(((radix + (1 << 63)) % (1 << 64)) - (1 << 63))
            radix *= p
    return score


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, raw in enumerate(vectors):
        v = np.frombuffer(raw, np.float64)
        out[i, : len(v)] = v
    return out


ROW = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("vec", T.BinaryType()),
    T.StructField("norm", T.DoubleType()), T.StructField("width", T.IntegerType()),
])


def _integers(scale: float):
    """Rows that take part, with their components as integers in bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = values.as_py()
                if i is None or label is None or v is None or any(x is None for x in v):
                    continue
                v = np.array(v, np.float64)
                whole = np.floor(scale * v) + 0.0
                norm = float(np.sqrt(whole @ whole))
                if not np.isfinite(v).all():
                    continue
                if not math.isfinite(norm):
                    raise ValueError("a component is too large for an integer score")
                rows.append((i, label, whole.tobytes(), norm, len(whole)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32()))],
                names=ROW.names,
            )

    return run


POSITIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _merge(k: int, kept: list[tuple] | None, found: list[tuple]) -> list[tuple]:
    return sorted([*(kept or []), *found])[:k]


def _scan(moduli: list[int], width: int, k: int, floor: tuple[int, int] | None):
    """Task over a block of anchors and a group of rows.

    Without ``floor``: the first k rows of the anchor's label.  With it (share as a fraction), the anchors come
    with their positives, and the first k rows of other labels with a score from that share of the positive's to
    the positive's.
    """
    schema = POSITIVE if floor is None else NEGATIVE

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best: dict[tuple, list[tuple]] = {}
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        who, kind = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        given = anchors.column("positives").to_pylist() if floor is not None else None
        a = _matrix(anchors.column("vec").to_pylist(), width)
        vectors = rows.column("vec")
        for at in range(0, len(ids), CHUNK):
            part, its = ids[at : at + CHUNK], labels[at : at + CHUNK]
            scores = product(a, _matrix(vectors.slice(at, CHUNK).to_pylist(), width), moduli)
            for i, row in enumerate(scores):
                if floor is None:
                    use = np.flatnonzero((its == kind[i]) & (part != who[i]))
                    wanted = [((int(who[i]),), use)]
                else:
                    other = np.flatnonzero(its != kind[i])
                    its_scores = row[other]
                    wanted = []
                    for p in given[i]:
                        top = p["score"]
                        least = -((-top * floor[0]) // floor[1])
                        use = other[(its_scores >= least) & (its_scores <= top)]
                        wanted.append(((int(who[i]), p["id"], top), use))
                for key, use in wanted:
                    if len(use):
                        use = use[_first(row[use], part[use], k)]
                        best[key] = _merge(k, best.get(key), [(-int(row[j]), int(part[j])) for j in use])
        if floor is None:
            out = [(key[0], j, -minus) for key, found in best.items() for minus, j in found]
        else:
            out = [(*key, j, -minus) for key, found in best.items() for minus, j in found]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(len(schema))], names=schema.names)

    return run


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    label: Column | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of ``floor(scale * component)``.  The positives of an anchor are the first
    rows of its label, other than itself; a positive's negatives are the first rows of other labels whose
    score lies between ``share`` of the positive's score and that score, both included.  First means larger
    score, then smaller id.  ``is_anchor`` is a condition on ``id``, ``label`` an expression on the rows.

    Rows without an id, label or vector, or with a null or non-finite component, take no part.  Rows that
    repeat an id count once (the one with the smallest label and then vector).  A shorter vector counts as one with
    zeros behind it; an empty one scores 0.  Scores that don't fit 63 bits are an error.  An anchor without positives, and a
    positive without negatives, have no rows; so an empty table gives an empty result.  Other columns
    are not read.
    """
    source = vectors.select(
        F.col(vec_id).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(embedding).alias("vec")
    )
    rows = source.mapInArrow(_integers(scale), ROW)
    rows = staged(rows.groupBy("id").agg(F.min(F.struct("label", "vec", "norm", "width")).alias("r")).select("id", "r.*"))
    told = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max("width").alias("width"),
        F.max(F.when(is_anchor, F.col("norm"))).alias("anchor_norm"), F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    bound = math.ceil((told["norm"] or 0.0) * (told["anchor_norm"] or 0.0) * (1 + 1e-9)) + 1
    if bound >= 1 << 63:
        raise ValueError("scores may not fit 63 bits")
    moduli, width = primes(bound), told["width"] or 0
    blocks, groups = max(1, math.ceil(told["anchors"] / ANCHORS)), max(1, math.ceil(told["n"] / ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    keys = ["block", "group"]
    right = rows.select(of(groups, 1).alias("group"), every(blocks).alias("block"), "id", "label", "vec").groupBy(*keys)
    anchors = rows.where(is_anchor).select("id", "label", "vec")

    def cells(some: DataFrame, floor: tuple[int, int] | None) -> DataFrame:
        left = some.withColumn("block", of(blocks, 2)).withColumn("group", every(groups))
        schema = POSITIVE if floor is None else NEGATIVE
        return left.groupBy(*keys).cogroup(right).applyInArrow(_scan(moduli, width, positives if floor is None else negatives, floor), schema)

    found = cells(anchors, None)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = found.withColumn("n", rank).where(F.col("n") <= positives)
    # at most ``positives`` structs an anchor
    chosen = chosen.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives")
    )
    asked = staged(anchors.join(chosen, "id"))
    hits = cells(asked, share)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

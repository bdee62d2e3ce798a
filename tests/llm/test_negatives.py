from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import negatives
from punctual.llm.queries import op12_residue_hard_negatives


def brute(rows, anchor, k=5, m=5):
    """Plain Python integers, pair by pair."""
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        use.setdefault(i, (label, whole))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in use.items():
        if not anchor(a):
            continue
        scored = sorted((-dot(v, w), i, its) for i, (its, w) in use.items() if i != a)
        for minus, p, its in [s for s in scored if s[2] == label][:k]:
            fits = [(n, s) for s, n, other in scored if other != label and 80 * -minus <= 100 * -s <= 100 * -minus]
            out += [(a, p, r + 1, n, -minus, -s) for r, (n, s) in enumerate(fits[:m])]
    return sorted(out)


def vectors(n, dim, seed, kinds=3, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (n, dim)).astype(np.float32)
    base[:copies] = base[0]
    base += np.float32(0.05)
    return [(i, [float(x) for x in v], int(rng.integers(0, kinds))) for i, v in enumerate(base)]


def told(df, is_anchor=F.col("id") % 10 == 0):
    return sorted(tuple(r) for r in negatives.mine(df, is_anchor).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_product_is_exact_at_any_size():
    rng = np.random.default_rng(1)
    for size, dim in [(300, 64), (2**20, 700), (2**28, 9), (2**30, 4)]:
        a, b = (rng.integers(-size, size + 1, (n, dim)).astype(float) for n in (5, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        bound = int(np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max())) + 1
        assert negatives.product(a, b, negatives.primes(bound)).tolist() == want


def test_residues_are_centred():
    v = np.array([-1e30, -1021.0, -255, -254, 0, 254, 255, 1021, 1e30])
    for p in (3, 251, 509):
        r = negatives.residues(v, p)
        assert abs(r).max() <= (p - 1) // 2 and [(int(x) - int(y)) % p for x, y in zip(v, r)] == [0] * len(v)


@pytest.mark.parametrize(("anchors", "rows_a_task", "chunk"), [(4096, 16_384, 1024), (3, 40, 7)])
def test_equals_brute_force(spark, monkeypatch, anchors, rows_a_task, chunk):
    """One task, and many blocks of anchors and groups of rows; ties through a third of equal vectors."""
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", rows_a_task)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = vectors(240, 12, 5, copies=80)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and told(frame(spark, rows)) == want


def test_rows_that_take_no_part(spark):
    good = vectors(40, 4, 9, kinds=2)
    bad = [
        (None, [0.1] * 4, 1), (50, None, 1), (51, [0.1, None, 0.2, 0.3], 0), (52, [float("nan")] * 4, 0), (53, [float("inf"), 0.0, 0.0, 0.0], 1),
        (54, [0.1] * 4, None), (60, [0.0] * 4, 0), (61, [], 1), (62, [0.5], 0),
    ]
    rows = good + bad
    assert told(frame(spark, rows + good[:7])) == brute(rows, lambda i: i % 10 == 0)


def test_nothing_to_find(spark):
    rows = vectors(20, 3, 2)
    assert told(frame(spark, rows).limit(0)) == []
    assert told(frame(spark, rows), F.col("id") < 0) == []
    assert told(frame(spark, [(0, [1.0], 1)])) == []
    assert told(frame(spark, [(i, [1.0, 2.0], 1) for i in range(30)])) == []


def test_scores_beyond_63_bits_are_refused(spark):
    with pytest.raises(ValueError, match="63 bits"):
        told(frame(spark, [(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 0)]))


def test_clashing_columns(spark):
    rows = vectors(60, 5, 4)
    df = frame(spark, rows)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("id", "vec", "block", "group", "rank", "positives", "anchor_id")])
    assert told(clash) == told(df) == brute(rows, lambda i: i % 10 == 0)


def test_query_moves_labels_of_every_seventh(spark, tmp_path):
    rows = vectors(420, 8, 6, kinds=10)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(tuple(r) for r in op12_residue_hard_negatives(spark, str(tmp_path)).collect())
    assert got == brute(moved, lambda i: i % 100 == 0) and got

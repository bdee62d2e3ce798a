from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import neighbours


def exact(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if is_query(q):
            ranked = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("old"))
    got = {}
    for r in neighbours.search(df, F.col("id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_small_tables_are_searched_in_full(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=3).tolist()) for i in range(9)] + [(20, [1.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0]), (41, [2.0, 0.0, 0.0])]
    rows += [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 2.0]), (64, [float("nan"), 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (80, [5.0, 5.0]), (81, [1.0, -1.0]), (20, [1.0, 0.0, 0.0])]
    got, want = found(spark, rows), exact(rows, lambda i: i % 20 == 0, 5)
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_many_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    r = np.random.default_rng(2)
    same = r.normal(size=8).tolist()
    rows = [(i, same if i % 3 == 0 else (r.normal(size=8)).tolist()) for i in range(300)]
    got, want = found(spark, rows), exact(rows, lambda i: i % 20 == 0, 5)
    assert [i for i, _ in got[60]] == [0, 3, 6, 9, 12] == [i for i, _ in want[60]]
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_empty_and_alone(spark):
    assert found(spark, [(1, [1.0, 2.0])]) == {} and found(spark, [(0, [1.0, 2.0])]) == {}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, F.col("id") % 20 == 0).count() == 0


def test_probes_come_in_order_of_chance():
    place = np.array([0.1, 0.5, 3.9])
    cells = neighbours.probe_order(place, 20)
    assert cells[0].tolist() == [0, 0, 3] and len({tuple(c) for c in cells.tolist()}) == 20
    assert [0, 0, 4] in cells[:3].tolist() and [-1, 0, 3] in cells[:3].tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = neighbours.search(df, F.col("id") % 20 == 0).toPandas()
    v = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(v["embedding"].to_numpy()).astype(float), v["vec_id"].to_numpy()
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        s[n] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[got["query_id"] == ids[n]]
        assert len(mine) == 20 and sorted(mine["rank"]) == list(range(1, 21))
        hits += len(want & set(mine["vec_id"]))
        total += 20
    assert hits >= 0.93 * total

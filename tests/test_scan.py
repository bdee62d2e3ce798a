from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.operators import scan as scan_module
from punctual.operators.scan import OrderedScan, range_borders


def rows(n=900, seed=5, hot=0.4):
    """One key with over a third of the rows, a null key, null values, many equal times."""
    rng = random.Random(seed)
    keys = ["a", "b", "c", None]
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(keys)
        time = None if rng.random() < 0.02 else rng.randrange(60)
        value = None if rng.random() < 0.2 else rng.randrange(-500, 500) / 4
        out.append((i, key, time, value))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "id int, k string, t int, v double").repartition(5).cache()


def brute(frame_rows):
    """Per row: earlier sum, earlier count, previous value, latest non-null value."""
    groups = {}
    for r in sorted(frame_rows, key=lambda r: ((r[2] is not None), r[2] or 0, r[0])):
        groups.setdefault(r[1], []).append(r)
    want = {}
    for members in groups.values():
        for i, r in enumerate(members):
            before = [m[3] for m in members[:i]]
            known = [v for v in before if v is not None]
            upto = [m[3] for m in members[: i + 1] if m[3] is not None]
            want[r[0]] = (sum(known) if known else None, i, before[-1] if before else None, upto[-1] if upto else None)
    return want


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_scan_equals_brute_force(frame, buckets):
    s = OrderedScan(frame, ["k"], ["t", "id"], buckets)
    out = (
        s.prior_sums({"s": F.col("v")}).prior_count("n").previous({"p": F.col("v")}).last_known("l", F.col("v")).result()
    )
    got = {r["id"]: (r["s"], r["n"], r["p"], r["l"]) for r in out.collect()}
    assert got == brute(rows())


@pytest.mark.parametrize("buckets", [1, 9])
def test_scan_without_keys(frame, buckets):
    out = OrderedScan(frame, [], ["t", "id"], buckets).prior_count("n").key_totals({"all": F.lit(1)}).result()
    got = out.select("n", "all").collect()
    assert sorted(r["n"] for r in got) == list(range(900)) and {r["all"] for r in got} == {900}


@pytest.mark.parametrize("buckets", [1, 6])
def test_key_totals(frame, buckets):
    out = OrderedScan(frame, ["k"], ["t", "id"], buckets).key_totals({"all": F.lit(1)}).result()
    sizes = pd.Series([r[1] for r in rows()]).value_counts(dropna=False)
    assert {(r["k"], r["all"]) for r in out.select("k", "all").distinct().collect()} == {
        (None if pd.isna(k) else k, n) for k, n in sizes.items()
    }


def test_no_group_exceeds_its_share(frame):
    """The hot key is spread over buckets of about equal size."""
    s = OrderedScan(frame, ["k"], ["t", "id"], 20)
    biggest = s.df.groupBy(*s.group).count().agg(F.max("count")).first()[0]
    assert biggest <= 3 * 900 / 20


def test_scan_takes_the_source_in_chains(frame):
    first = OrderedScan(frame, ["k"], ["t", "id"], 8).prior_sums({"s": F.col("v")}).result()
    chained = OrderedScan(first, ["k"], ["t", "id"], 8, source=frame).previous({"p": F.col("v")}).result()
    want = brute(rows())
    assert {r["id"]: (r["s"], r["p"]) for r in chained.collect()} == {i: (w[0], w[2]) for i, w in want.items()}


def test_borders_are_bounded_and_sorted(frame):
    borders = range_borders(frame, ["t", "id"], 10)
    assert 1 <= len(borders) <= 9
    assert borders == sorted(borders, key=lambda b: tuple((v is not None, v or 0) for v in b))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id int, k string, t int, v double")
    out = OrderedScan(empty, ["k"], ["t", "id"], 4).prior_sums({"s": F.col("v")}).last_known("l", F.col("v")).result()
    assert out.count() == 0


def test_every_input_is_bucketed(spark, tmp_path, monkeypatch):
    """One key in a tiny file: many rows hide behind few bytes."""
    path = str(tmp_path / "one")
    spark.range(200_000).select(F.lit("k").alias("k"), "id").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    scan = OrderedScan(df, ["k"], ["id"])
    assert scan.df.select("__bucket").distinct().count() == scan_module.LEAST_BUCKETS
    monkeypatch.setattr(scan_module, "TARGET_ROWS", 10_000)
    scan = OrderedScan(df, ["k"], ["id"])
    assert 15 <= scan.df.select("__bucket").distinct().count() <= 25
    assert scan.prior_count("n").result().where("n <> id").count() == 0


def test_timestamp_and_text_order(spark):
    data = [(i, f"k'{i % 3}\"é", f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(200)]
    df = spark.createDataFrame(data, "id int, k string, x string").withColumn("t", F.col("x").cast("timestamp")).repartition(4)
    plain = OrderedScan(df, ["k"], ["t", "id"], 1).prior_count("n").result()
    cut = OrderedScan(df, ["k"], ["t", "id"], 11).prior_count("n").result()
    pick = lambda d: {(r["id"], r["n"]) for r in d.collect()}
    assert pick(plain) == pick(cut)


def test_second_level_of_buckets(spark, frame, monkeypatch):
    """More buckets than the literal holds: finer borders inside each range, same results, small groups."""
    monkeypatch.setattr(scan_module, "FIRST", 4)
    monkeypatch.setattr(scan_module, "PER_BUCKET", 2)
    s = OrderedScan(frame, ["k"], ["t", "id"], 60)
    sizes = [r["count"] for r in s.df.groupBy(*s.group).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 900 / 8
    out = s.prior_sums({"s": F.col("v")}).prior_count("n").previous({"p": F.col("v")}).last_known("l", F.col("v")).result()
    assert {r["id"]: (r["s"], r["n"], r["p"], r["l"]) for r in out.collect()} == brute(rows())


def test_sample_is_drawn_where_the_rows_are(spark, monkeypatch):
    """No task of the sample reads rows of another: its plan has no exchange, its size no partitions."""
    monkeypatch.setattr(scan_module, "PER_BUCKET", 10)
    df = spark.range(100_000).repartition(50)
    sample = scan_module.RowSample(df, ["id"], 8)
    assert 40 <= len(sample.points) <= 160
    drawn = sample.drawn(80, 42)._jdf.queryExecution().executedPlan().toString()
    alone = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert drawn.count("Exchange") == alone.count("Exchange") and "TakeOrdered" not in drawn


def test_only_keys_of_borders_are_carried(frame):
    s = OrderedScan(frame, ["k"], ["t", "id"], 5)
    assert s.source.count() < 900
    carried = s._carry([F.count(F.lit(1)).alias("n")], lambda w: [F.col("n")])
    assert carried.count() <= 4


@pytest.mark.parametrize("keys", [["k"], []])
def test_unread_results_of_a_scan_cost_nothing(frame, keys):
    """What buckets hand on is no join, so a scan leaves the plan with the columns nobody reads."""
    s = OrderedScan(frame, keys, ["t", "id"], 7)
    out = s.prior_sums({"s": F.col("v")}).previous({"p": F.col("v")}).last_known("l", F.col("v")).result()
    unread = out.agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in unread and "Window" not in unread
    assert "Window" in out._jdf.queryExecution().optimizedPlan().toString()


def test_decimal_keys_that_look_alike_as_doubles(spark):
    """Such keys share a range, so one bucket may begin with several keys of earlier ones."""
    keys = ["100000000000000000001", "100000000000000000002"]
    data = [(i, keys[i % 2], i // 2) for i in range(80)]
    df = spark.createDataFrame(data, "id int, k string, t int").withColumn("k", F.col("k").cast("decimal(38,0)"))
    got = OrderedScan(df, ["k"], ["t"], 5).prior_count("n").result().collect()
    assert {r["id"]: r["n"] for r in got} == {i: i // 2 for i in range(80)}

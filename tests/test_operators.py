from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.operators import aggregate, history, join, project, quantile, split


# --- as-of -----------------------------------------------------------------------------------
def test_asof_edges(spark):
    left = spark.createDataFrame(
        [(1, "s", "2024-01-01 03:00:00"), (2, "s", "2024-01-01 03:00:01"), (3, None, "2024-01-01 03:00:00"), (4, "s", None), (5, "z", "2024-01-01 03:00:00")],
        "id int, k string, x string",
    ).withColumn("t", F.col("x").cast("timestamp"))
    right = spark.createDataFrame(
        [("s", "2024-01-01 00:00:00", 1, 1), ("s", "2024-01-01 00:00:00", 2, 2), (None, "2024-01-01 02:00:00", 9, 9)],
        "k string, x string, seq int, v int",
    ).withColumn("t", F.col("x").cast("timestamp"))
    for buckets in (1, 3):
        out = join.asof_join(left, right, "k", "k", "t", "t", {"v": "v"}, "3 HOURS", tie_order=["seq"], buckets=buckets)
        assert {r["id"]: r["v"] for r in out.collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("buckets", [1, 13])
def test_asof_equals_pandas(spark, buckets):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"id": range(600), "k": rng.choice(["hot", "hot", "a", "b"], 600), "m": rng.integers(0, 3000, 600)})
    right = pd.DataFrame({"k": rng.choice(["hot", "a", "c"], 300), "m": rng.choice(5000, 300, replace=False), "v": rng.normal(size=300)})
    right.loc[::7, "v"] = np.nan
    base = pd.Timestamp("2024-01-01")
    want = pd.merge_asof(
        left.assign(t=base + pd.to_timedelta(left.m, "min")).sort_values("t"),
        right.assign(t=base + pd.to_timedelta(right.m, "min"), rm=right.m).sort_values("t")[["k", "t", "v", "rm"]],
        on="t", by="k", tolerance=pd.Timedelta("3h"),
    )
    stamp = lambda f: spark.createDataFrame(f).withColumn("t", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("m") * 60))
    out = join.asof_join(stamp(left), stamp(right), "k", "k", "t", "t", {"v": "v", "rm": "m"}, "3 HOURS", buckets=buckets).toPandas()
    merged = out.merge(want, on="id", suffixes=("", "_want"))
    assert len(merged) == 600
    pd.testing.assert_series_equal(merged["rm"].astype(float), merged["rm_want"].astype(float), check_names=False)
    pd.testing.assert_series_equal(merged["v"], merged["v_want"], check_names=False)


def test_asof_with_a_hash_at_hand(spark, monkeypatch):
    """Borders are found from key, time and the hash alone; the matches stay the same."""
    read = []

    class Sample(join.RowSample):
        def __init__(self, df, names, buckets=None):
            read.append(df._jdf.queryExecution().optimizedPlan().toString())
            super().__init__(df, names, buckets)

    monkeypatch.setattr(join, "RowSample", Sample)
    at = lambda f: f.withColumn("t", F.timestamp_seconds("s"))
    left = at(spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 37 % 50).alias("s")))
    right = at(spark.range(40).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("s"), F.col("id").alias("v")))
    hashed = left.withColumn("h", F.xxhash64("id", "k", "s", "t"))
    plain = join.asof_join(left, right, "k", "k", "t", "t", {"v": "v"}, None, buckets=5)
    got = join.asof_join(hashed, right, "k", "k", "t", "t", {"v": "v"}, None, buckets=5, mix="h")
    assert sorted(plain.collect()) == sorted(got.drop("h").collect())
    assert read[0].count("xxhash64") == 1 and got.columns == [*left.columns, "h", "v"]


# --- history ---------------------------------------------------------------------------------
def events(spark, n=400, seed=1, until=None):
    rng = random.Random(seed)
    data = [
        (i, rng.choice("AAAB"), rng.choice("xy"), rng.randrange(0, 72 * 60), float(rng.randrange(-20, 90)), i % 13 == 0)
        for i in range(n)
    ]
    if until is not None:
        data = [d for d in data if d[3] <= until]
    df = spark.createDataFrame(data, "id int, origin string, carrier string, minute int, delay double, lost boolean")
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return df.withColumns({
        "t": F.timestamp_seconds(start + F.col("minute") * 60),
        "delay": F.when(~F.col("lost"), F.col("delay")),
        "flag": F.coalesce((F.col("delay") >= 15).cast("int"), F.lit(0)),
    })


def featured(df, buckets=None):
    df = history.prior_means(df, "t", "delay", {"pm": ["origin", "carrier"]}, ["id"], buckets=buckets)
    df = history.prior_count_in_hour(df, "t", "origin", "pc", ["id"], buckets=buckets)
    df = history.previous_leg(df, "t", "carrier", "delay", "leg", "has", ["id"], buckets=buckets)
    df = history.previous_period_features(df, "t", "delay", "flag", {"origin": "o", "carrier": "c"}, rolling=("o",))
    return {r["id"]: tuple(r[c] for c in ("pm", "pc", "leg", "has", "o_avg_dep_delay_prev_hour", "o_delay_rate_prev_3h", "c_avg_dep_delay_prev_hour")) for r in df.collect()}


def test_features_ignore_the_future(spark):
    """Removing later rows changes no feature of the rows that stay."""
    everything, past = featured(events(spark)), featured(events(spark, until=40 * 60))
    assert past and all(everything[i] == f for i, f in past.items())


def test_features_do_not_depend_on_the_path(spark):
    assert featured(events(spark), buckets=1) == featured(events(spark), buckets=9)


def test_previous_period_equals_plain_loop(spark):
    """Each entity's observed hours in order: the one before, and the rates of up to three before."""
    df = events(spark)
    rows = df.select("id", "origin", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / 3600).alias("h"), "delay", "flag").collect()
    mean = lambda values: sum(values) / len(values) if values else None
    known = lambda values: [v for v in values if v is not None]
    want = {}
    for origin in {r["origin"] for r in rows}:
        hours = sorted({r["h"] for r in rows if r["origin"] == origin and r["h"] is not None})
        for i, hour in enumerate(hours):
            of = lambda h, c: known([r[c] for r in rows if r["origin"] == origin and r["h"] == h])
            before = mean(of(hours[i - 1], "delay")) if i else None
            rate = mean(known([mean(of(h, "flag")) for h in hours[max(0, i - 3) : i]]))
            want[origin, hour] = (before, rate) if origin is not None else (None, None)
    out = history.previous_period_features(df, "t", "delay", "flag", {"origin": "o"}, rolling=("o",))
    got = {r["id"]: (r["o_avg_dep_delay_prev_hour"], r["o_delay_rate_prev_3h"]) for r in out.collect()}
    close = lambda x, y: x == y if x is None or y is None else abs(float(x) - float(y)) < 1e-9
    assert len(got) == len(rows)
    for r in rows:
        assert all(close(x, y) for x, y in zip(got[r["id"]], want.get((r["origin"], r["h"]), (None, None)), strict=True)), r


def test_previous_leg_without_entity_column(spark):
    out = history.previous_leg(events(spark), "t", "tail", "delay", "leg", "has", ["id"])
    assert {(r["leg"], r["has"]) for r in out.select("leg", "has").collect()} == {(None, 0)}


# --- splits ----------------------------------------------------------------------------------
def days(spark, n):
    return spark.range(n).withColumn("d", F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")))


def test_temporal_split(spark):
    train, test, cut = split.temporal_split(days(spark, 10), "d")
    assert (train.count(), test.count(), str(cut)) == (8, 2, "2023-01-09")
    with pytest.raises(ValueError):
        split.temporal_split(days(spark, 1), "d")


def test_temporal_folds(spark):
    df = days(spark, 365)
    sizes = [(a.count(), b.count()) for a, b in split.temporal_folds(df, "d", 4)]
    assert sizes == [(73, 73), (146, 73), (219, 73), (292, 73)]
    roles = split.with_folds(df, "d", 4).groupBy("fold", "role").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    spans = {(r["fold"], r["role"]): (r["lo"], r["hi"]) for r in roles}
    assert all(spans[(f, "train")][1] < spans[(f, "test")][0] for f in range(1, 5))
    with pytest.raises(ValueError):
        split.temporal_folds(days(spark, 4), "d", 4)


@pytest.mark.parametrize("cap", [50, 20_000])
def test_sample_cap(spark, cap):
    df = spark.range(30_000)
    a = {r["id"] for r in split.sample_cap(df, cap, ["id"]).collect()}
    b = {r["id"] for r in split.sample_cap(df.repartition(13), cap, ["id"]).collect()}
    assert len(a) == cap and a == b
    assert split.sample_cap(spark.range(30), cap, ["id"]).count() == 30


def test_balanced_sample(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 10).cast("int"))
    got = split.balanced_sample(df, "y", 80, ["id"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 10, 0: 70}


# --- aggregates ------------------------------------------------------------------------------
def test_skewness_and_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert df.agg(aggregate.corrected_skewness(F.col("x"))).first()[0] == pytest.approx(1.763632614803888)
    assert quantile.exact_quantiles(df, ["x"], [0.5]).first()["quantile"] == 2.5
    two = spark.createDataFrame([(1.0, 3.0, 1), (2.0, 3.0, 1)], "a double, b double, c int")
    assert aggregate.skewness_table(two, ["a", "b"]).count() == 0
    three = two.unionAll(two)
    assert aggregate.skewness_table(three, ["a"]).first()["skew"] == pytest.approx(0.0)
    flat = {r["feature"]: r["a"] for r in aggregate.pearson_with(three, ["a", "b", "c"], ["a"]).collect()}
    assert flat == {"a": pytest.approx(1.0), "b": None, "c": None}


@pytest.mark.parametrize(("keep", "accuracy"), [(20_000, 10_000), (0, 10_000), (3, 2)])
def test_quantiles_equal_numpy(spark, keep, accuracy):
    rng = np.random.default_rng(0)
    data = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, 101)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double")
    probabilities = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = quantile.exact_quantiles(df, ["x"], probabilities, ["k"], keep, accuracy).collect()
    for r in got:
        values = [v for k, v in data if k == r["k"] and v is not None]
        assert r["quantile"] == pytest.approx(np.quantile(values, r["probability"]))
    assert len(got) == 4 * len(probabilities)


def test_quantiles_of_spread_values_and_no_rows(spark):
    """Values over many orders of magnitude, infinities, a third of one value; columns without values have no row."""
    rng = np.random.default_rng(2)
    data = [float(v) for v in np.exp(rng.normal(0, 80, 700)) * rng.choice([-1, 1], 700)] + [7.5] * 350 + [float("inf"), 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in data], "x double").withColumn("void", F.lit(None).cast("double"))
    got = {r["probability"]: r["quantile"] for r in quantile.exact_quantiles(df, ["x", "void"], [0.0, 0.1, 0.5, 0.9], keep=10, accuracy=5).collect()}
    assert got == pytest.approx({p: float(np.quantile(np.array(data), p)) for p in got}) and len(got) == 4
    assert quantile.exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_quantiles_shuffle_no_rows(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("x"))
    assert quantile.exact_quantiles(df, ["x"], [0.25, 0.5]).orderBy("probability").collect()[0]["quantile"] == 12_499.75


def test_dedupe_and_preference(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")], "k string, o int, v string")
    kept = aggregate.dedupe_keep_first(df, ["k"], ["o"]).collect()
    assert {(r["k"], r["o"], r["v"]) for r in kept} == {("a", 1, "y"), (None, 4, "w")}
    liked = aggregate.prefer_if_any(df, ["k"], F.col("v") == "x").collect()
    assert {(r["k"], r["v"]) for r in liked} == {("a", "x"), (None, "z"), (None, "w")}


def test_duplicates_and_reduction(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    assert aggregate.duplicate_count(df, ["a", "b"]).first()[0] == 1
    assert aggregate.duplicate_count(df.limit(0), ["a"]).first()[0] == 0
    stages = spark.createDataFrame([(1, 100), (2, 40)], "position int, rows bigint")
    last = aggregate.stage_reduction(stages).where("position = 2").first()
    assert (last["rows_removed_from_previous"], last["share_retained_from_full"]) == (60, 0.4)


def test_hot_group_copies_collapse(spark):
    """A third of all rows are copies of one key."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit(7).alias("v"))
    assert aggregate.dedupe_keep_first(df, ["k"], ["v"]).count() == 6001


# --- projections and joins -------------------------------------------------------------------
def test_filters(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-05"), (None, "2024-01-09")], "k string, x string")
    df = df.withColumn("d", F.col("x").cast("date"))
    assert project.filter_in(df, "k", []).count() == 3
    assert project.filter_in(df, "k", ["a"]).count() == 1
    assert project.filter_in(df, "k", [f"v{i}" for i in range(1500)] + ["b"]).count() == 1
    assert project.filter_date_range(df, "d", "2024-01-05", "2024-01-09").count() == 2
    assert project.filter_date_range(df, "d").count() == 3


def test_top_entities(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] * 3 + [("c",)] * 1 + [(None,)] * 9, "k string")
    assert {r["k"] for r in project.keep_top_entities(df, "k", 2).collect()} == {"a", "b"}
    assert [r["k"] for r in project.top_entities(df, "k", 1).collect()] == ["a"]
    assert project.keep_top_entities(df, "k", 0).count() == 16


def test_live_features(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"))], "a double, b double, c double")
    assert project.non_null_features(df, ["a", "b", "c"]) == ["a"]


def test_repeated_dimension_keys(spark):
    dim = spark.createDataFrame([("a", "N"), ("a", "S"), ("b", "N")], "airport string, state string")
    assert [tuple(r) for r in join.repeated_keys(dim, "airport").collect()] == [("a", 2)]


def test_upsert_and_compare(spark):
    old = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "model string, f1 double")
    new = spark.createDataFrame([("m", 3.0)], "model string, f1 double")
    assert {(r["model"], r["f1"]) for r in join.upsert_metrics(old, new).collect()} == {("m", 3.0), ("n", 2.0)}


def test_cells_of_many_edges_are_generated_code(spark, capsys):
    """Values are placed among any number of edges by a binary search, not by a lambda over all of them."""
    edges = [float(x) for x in range(0, 600, 2)]
    table = quantile._edges(spark.createDataFrame([("v", edges), (None, edges[:70])], "feature string, edges array<double>"))
    values = [-1.0, 0.0, 0.5, 137.0, 138.0, 139.0, 598.0, 700.0]
    long = spark.createDataFrame([(f, v) for f in ("v", None) for v in values], "feature string, value double")
    placed = quantile._in_cells(long, table, ["feature"])
    placed.explain()
    assert "lambdafunction" not in capsys.readouterr().out
    for r in placed.collect():
        own = edges if r["feature"] else edges[:70]
        assert r["cell"] == 2 * sum(e < r["value"] for e in own) + (r["value"] in own)

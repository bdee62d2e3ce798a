from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from punctual.plans import increment

PLAN = increment.HistoryPlan("t", "v", {"by_k": ["k"], "by_kg": ["k", "g"]}, "k", "earlier", "g", "v", "leg", "has", ["id"])
SCHEMA = "id int, t timestamp, k string, g string, v double"


def rows(spark, n=400, seed=4):
    """Null keys, null values, equal times, one key with half of the rows."""
    rng = random.Random(seed)
    pick = lambda names: rng.choice(names)
    data = [
        (i, rng.randrange(40) * 1500, "hot" if rng.random() < 0.5 else pick(["a", "b", None]), pick(["x", "y", "z", None]), pick([None, -1.5, 0.25, 7.0]))
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "id int, s long, k string, g string, v double")
    return df.select("id", F.timestamp_seconds("s").alias("t"), "k", "g", "v")


def told(df):
    return sorted(tuple(r) for r in df.select("id", "by_k", "by_kg", "earlier", "leg", "has").collect())


@pytest.mark.parametrize("cuts", [[20_000], [1_500, 9_000, 9_100, 30_000], [-1, 70_000]])
def test_batches_equal_one_build(spark, tmp_path, cuts):
    """Cuts inside an hour, batches without rows, states written and read back."""
    df = rows(spark)
    whole, _ = increment.continue_history(df, PLAN)
    state, got = None, []
    for i, (low, high) in enumerate(zip([-100, *cuts], [*cuts, 10**6])):
        batch = df.where(F.unix_seconds("t").between(low + 1, high))
        part, after = increment.continue_history(batch, PLAN, state, buckets=3)
        got += told(part)
        after.save(str(tmp_path / str(i)))
        state = increment.HistoryState.load(spark, str(tmp_path / str(i)), PLAN)
    assert sorted(got) == told(whole)


def test_late_rows_are_refused_and_no_state_is_none(spark, tmp_path):
    df = rows(spark, 50)
    _, state = increment.continue_history(df, PLAN)
    with pytest.raises(ValueError, match="saved history ends"):
        increment.continue_history(df.limit(1), PLAN, state)
    assert increment.HistoryState.load(spark, str(tmp_path / "none"), PLAN) is None
    state.means["by_k"].write.parquet(str(tmp_path / "half" / "mean_by_k"))
    assert increment.HistoryState.load(spark, str(tmp_path / "half"), PLAN) is None


def test_the_state_is_small(spark):
    """One row for each key, whatever the number of rows; of the hours only the last."""
    df = rows(spark, 400)
    _, state = increment.continue_history(df, PLAN)
    assert state.means["by_k"].count() == 4 and state.legs.count() == 4
    assert state.hours.select("hour").distinct().count() == 1

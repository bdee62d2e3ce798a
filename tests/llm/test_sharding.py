from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from punctual.llm import sharding


def by_turns(shards, slots):
    """The table from each shard's full order of preference."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = []
    for s in shards:
        first, step = number(f"{s}/first") % slots, number(f"{s}/step") % (slots - 1) + 1
        orders.append([(first + j * step) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 3), (3, 101), (7, 251), (11, 11)])
def test_fill_equals_plain_turns(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.fill(shards, slots) == by_turns(shards, slots)


def test_shares_differ_by_one_and_little_moves():
    shards = [f"s{i}" for i in range(20)]
    before = sharding.fill(shards, 8191)
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    after = sharding.fill(shards[:-1], 8191)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.15 * 8191


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 1_000_004)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_place_odd_rows(spark):
    rows = [(1, "x", "old", 5), (1, "x", "old", 5), (None, None, None, None), (2, "y" * 100_000, "old", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, SLOT int")
    got = sharding.place(df, "doc_id", ["a", "b", "c"], 101)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    out = got.collect()
    table = sharding.fill(["a", "b", "c"], 101)
    for r in out:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert len(out) == 4
    empty = sharding.place(df.limit(0), "doc_id", ["a"], 101)
    assert empty.count() == 0 and empty.columns == got.columns


def test_place_stays_in_the_jvm(spark):
    plan = sharding.place(spark.range(10), "id", ["a", "b"], 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan

from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest

from punctual.llm import mixing

WEIGHTS = (3.0, 1.0, 2.0)


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = set(), min(share * sum(sizes.values()), most * sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(docs, **more):
    return mixing.mix(docs, **more).collect()


@pytest.fixture(scope="module")
def corpus(prose):
    rows, n = [], 0
    for k, (source, docs) in enumerate([("b", 60), ("a", 5), (None, 12), ("c", 30), ("", 8)]):
        for i in range(docs):
            rows.append((n, prose(3 + (i * 37 + k) % 90, n), source))
            n += 1
    return rows + [(n, None, "a"), (n + 1, " \t\n ", "zero"), (n + 2, "", None), (None, prose(40, 9), "b"), (3, rows[3][1], "b"), (n + 3, prose(5000, 1), "c")]


def test_targets_and_taken(docs_of, corpus):
    got = mixed(docs_of(corpus), block=16)
    sizes = defaultdict(int)
    for _, text, source in corpus:
        sizes[source] += words(text)
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted(
        (i is None, i or 0, words(t)) for i, t, _ in corpus
    )


def test_reruns_agree_and_block_size_is_no_matter(docs_of, corpus):
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in rows)
    df = docs_of(corpus)
    first = key(mixed(df, block=16))
    assert first == key(mixed(df.repartition(7), block=16)) == key(mixed(df, block=64))


def test_equal_rows_without_words_all_come_back(docs_of, prose):
    rows = [(1, "", "a"), (1, "", "a"), (None, None, "a"), (None, None, "a"), (None, "", "a"), (2, prose(30, 1), "a"), (2, prose(30, 1), "a"), (3, " ", None), (3, " ", None)]
    got = mixed(docs_of(rows), block=16)
    key = lambda i, n: (i is None, i or 0, n)
    assert sorted(key(r["doc_id"], r["size"]) for r in got) == sorted(key(i, words(t)) for i, t, _ in rows)
    assert all(r["taken"] == 0 for r in got if not r["size"])


def test_a_source_below_a_unit_of_the_range_is_scheduled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 1 << 10)
    monkeypatch.setattr(mixing, "CELL", 1 << 4)
    targets = spark.createDataFrame([("a", 5000, 5000.0), ("b", 1, 1.0), ("c", 2, 2.0)], "source string, source_size long, target double")
    got = {r["source"]: r["w"] for r in mixing.schedule(targets, 1).groupBy("source").sum("words").toDF("source", "w").collect()}
    assert got == {"a": 5000, "b": 1, "c": 2}


def test_slots_of_a_document_follow_the_schedule(docs_of, spark, corpus):
    """Every piece of a document by plain loops over the points of the sequence."""
    df, block = docs_of(corpus), 16
    got = mixed(df, block=block)
    sizes = defaultdict(int)
    for _, text, source in corpus:
        sizes[source] += words(text)
    targets = spark.createDataFrame([(s, n, float(plain_targets(sizes)[s])) for s, n in sizes.items()], "source string, source_size long, target double")
    slots = defaultdict(list)
    for r in mixing.schedule(targets, block).collect():
        slots[r["source"], r["block_no"]].append((r["slot"], r["words"]))
    for source in sizes:
        at = 0
        for r in sorted((r for r in got if r["source"] == source and r["size"]), key=lambda r: (r["place"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
            end, want, taken = at + r["size"], [], 0
            for b in range(at // block, (end - 1) // block + 1):
                for slot, n in slots[source, b]:
                    part = min(b * block + n, end) - max(at, b * block)
                    if part > 0:
                        want.append(slot)
                        taken += part
            assert (r["slots"], r["taken"]) == (sorted(want), taken)
            at = end
    assert all(r["slots"] == [] for r in got if not r["size"])


def test_schedule_spreads_sources(spark):
    targets = spark.createDataFrame([("a", 9000, 9000.0), ("b", 3000, 3000.0), ("c", 1000, 2000.0)], "source string, source_size long, target double")
    slots = mixing.schedule(targets, 10).orderBy("slot").collect()
    count = defaultdict(int)
    for i, r in enumerate(slots, 1):
        assert r["rank"] == count[r["source"]]
        count[r["source"]] += 1
        if i <= 1000:  # while all sources last, each is close to its share at any moment
            for s, share in (("a", 9 / 14), ("b", 3 / 14), ("c", 2 / 14)):
                assert abs(count[s] - share * i) < 6
    assert dict(count) == {"a": 900, "b": 300, "c": 200}
    assert sum(r["words"] for r in slots) == 14_000


def test_empty_and_wordless(docs_of, spark):
    assert mixed(docs_of([(1, "a", "x")]).limit(0)) == []
    got = mixed(docs_of([(1, None, None), (2, "", "x")]))
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_clashing_columns(docs_of, spark):
    from pyspark.sql import functions as F

    df = docs_of([(1, "a b c", "x"), (2, "d", "y")]).withColumns({c: F.lit("old") for c in ("size", "place", "taken", "target", "bucket", "slot")})
    assert sorted((r["doc_id"], r["size"]) for r in mixed(df)) == [(1, 3), (2, 1)]

"""The stages against plain Python on a small corpus, and the registered queries on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline as pipeline
from punctual.llm import decontamination, sharding
from punctual.llm.queries import SHARDS, SLOTS
from tests.llm.test_mixing import plain_targets, words
from tests.llm.test_overlap import corpus, plain_components

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
OPS = sorted(n for n in entry_points.queries() if n.startswith("op"))


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "A question about " + "the deep river and its long way down to the sea " * 3)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_one_of_each_group(spark, docs_of, prose, sf):
    rows = corpus(prose, 7)
    docs = docs_of(rows)
    got = pipeline.keep_one_of_each(spark, docs, sf)
    assert got.columns == docs.columns
    of = plain_components(rows, pipeline.WORDS, round(1000 * pipeline.SIMILARITY))
    want = Counter(i for i, c in of.items() if i == c) + Counter([None] * sum(i is None for i, _ in rows))
    assert Counter(r["doc_id"] for r in got.collect()) == want


def test_clean(spark, docs_of, prose, sf):
    item = "A question about " + "the deep river and its long way down to the sea " * 3
    docs = docs_of([(1, prose(50, 1)), (2, prose(9, 2) + " " + item), (3, None), (None, item)])
    assert sorted(r["doc_id"] for r in pipeline.keep_clean(spark, docs, sf).collect()) == [1, 3]
    assert decontamination.normalized(item)[0].size > 100


def test_mixed_rows(spark, docs_of, prose, sf):
    rows = [(i, prose(20 + i % 30, i), "abc"[i % 3] if i % 5 else None) for i in range(200)] + [(500, "", "a"), (501, None, None)]
    docs = docs_of(rows)
    got = pipeline.mix_sources(spark, docs, sf)
    assert got.columns == docs.columns
    out = got.collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies.values()) <= {1, 2} and copies[500] == copies[501] == 1
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    taken = Counter()
    for r in out:
        taken[r["source"]] += words(r["text"])
    want = plain_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes)


def test_shards(spark, docs_of, sf):
    docs = docs_of([(1, "a"), (1, "a"), (None, None)])
    owner = sharding.fill(SHARDS, SLOTS)
    got = pipeline.place_shards(spark, docs, sf).collect()
    assert len(got) == 3 and all(r["shard"] == SHARDS[owner[r["slot"]]] for r in got)


def test_empty_stages(spark, docs_of, sf):
    empty = docs_of([(1, "a")]).limit(0)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


@here
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "slot", "shard"] and 0 < out.count() < 2 * docs.count()
    assert [n for n, _ in pipeline.STAGES][0] == "quality classifier" and len(pipeline.STAGES) == 5


@here
@pytest.mark.parametrize("name", OPS)
def test_registered_query(spark, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    table = {"op2": "embeddings", "op6": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.startswith("op2"):
        assert len(got) == 20 * got["query_id"].nunique()
    elif not name.startswith("op3"):
        assert len(got) == rows
    if name in entry_points.oracle_sql():
        from tools.check import compare

        con = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        assert compare(got, con.sql(entry_points.oracle_sql()[name]).df()).startswith("ok")


def test_all_ten_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in OPS} == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry_points.queries()

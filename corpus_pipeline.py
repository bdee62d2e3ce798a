"""From raw documents to a mixed, sharded training corpus, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import decontamination, mixing, overlap, quality, sharding
from punctual.llm.prune import marked
from punctual.llm.queries import SHARDS, SLOTS, held_out, table
from punctual.session import staged

#: Lowest score of a document that stays.
QUALITY = 0.7
#: Near duplicates: shingles of so many words, and the least similarity.
WORDS, SIMILARITY = 5, 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least QUALITY; rows are judged one by one, nulls as empty texts."""
    seen = ~held_out(F.col("doc_id"))
    model = quality.fit(docs.where(seen), table(spark, sf_dir, "labels").where(seen))
    added = ["size_difference", "score"]
    scored = quality.score(docs.drop(*added), model)
    return scored.where(F.col("score") >= QUALITY).drop(*added)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by near-equal texts the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays.  Rows without a doc_id take no part and stay.
    """
    groups, _ = overlap.join(docs, WORDS, SIMILARITY)
    groups = staged(groups.select("doc_id", "component_id").where("doc_id is not null"))
    out = staged(groups.where("doc_id <> component_id").select("doc_id").distinct())
    twice = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = marked(docs, [F.col("doc_id").cast("long")], out.union(twice))
    rest = rows.where("__maybe and doc_id is not null").join(out, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return rows.where("not __maybe or doc_id is null").select(docs.columns).union(rest.select(docs.columns))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none, once or twice, in whole rows.

    The few documents that the end of a source's last block cuts are rounded; rows without words
    stay once; rows equal in id and text are taken alike.
    """
    taken = mixing.mix(docs)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    picks = taken.withColumn("__copies", copies).groupBy(F.col("doc_id").alias("__id"), F.col("place").alias("__place")).agg(
        F.round(F.avg("__copies")).cast("int").alias("__copies")
    ).where("__copies > 0")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (mixing.place_of(F.col("doc_id"), F.col("text")) == F.col("__place"))
    rows = docs.join(picks, match).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(docs.columns)


def place_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return sharding.place(docs, "doc_id", SHARDS, SLOTS)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
    ("sharding", place_shards),
]

#: zstandard sizes, and with them the first stage, have no SQL; tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs

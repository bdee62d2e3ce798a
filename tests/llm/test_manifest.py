from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from punctual.llm import manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def runs(nodes, fan=3):
    return [nodes[i : i + fan] for i in range(0, len(nodes), fan)]


def climb(nodes):
    """Root, and for each node the list of (before, after) up to it, by rebuilding every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            run, slot = runs(nodes)[at[i] // 3], at[i] % 3
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] //= 3
        nodes = [H(*run) for run in runs(nodes)]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, in any order."""
    groups = {}
    for r in rows:
        tampered = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            tampered[4] = r[4].replace("\n", "")
        groups.setdefault(r[1], []).append((r[0], H(*map(code, r)), H(*map(code, tampered))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done[g] = climb([leaf for _, leaf, _ in groups[g]])
    root, above = climb([done[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for (i, leaf, tampered), path in zip(groups[g], done[g][1], strict=True):
            folded = tampered
            for before, after in path + up:
                folded = H(before, folded, after)
            out.append((i, leaf, done[g][0], root, H(*[b + a for b, a in path + up]), folded, folded == root))
    return sorted(out, key=str)


def told(df, levels=manifest.LEVELS):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest.manifest(df, carry={"other": manifest.leaf_of([*[F.col(c) for c in FIELDS[:-1]], text])}, levels=levels)
    got = out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256),
        manifest.fold(F.col("other"), F.col("path")).alias("folded"),
    ).withColumn("ok", F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


def some(sizes, seed=3):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a\nb\n", "x" * 50, "é\n漢字", "plain"])
    return [
        (i * 100 + k, name, rng.choice(["en", None, ""]), rng.choice([None, 3, -4]), text())
        for k, (name, size) in enumerate(sizes.items()) for i in rng.sample(range(size * 2), size)
    ]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_rebuilt_trees(spark, levels):
    """Trees of one leaf, of whole and of cut runs, far above a block; groups by bytes, null first."""
    rows = some({"b": 1, "a": 3, None: 4, "": 9, "é": 10, "Z": 28, "hot": 120})
    assert told(frame(spark, rows), levels) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = some({"a": 5}) + [(None, None, None, None, None)] * 11 + [(7, "a", "en", 1, "same\n")] * 4 + [(7, "a", "en", 1, "other\n")] * 2
    rows += [(None, "a", None, None, "t\n")]
    assert told(frame(spark, rows), 1) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(4, "s", "en", 1, "a\nb")]
    assert told(frame(spark, rows)) == brute(rows)
    assert told(frame(spark, rows).limit(0)) == []


def test_only_new_lines_of_even_ids_are_found(spark):
    rows = [(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(200)] + [(900, "s", None, None, None)]
    verified = {r[0]: r[6] for r in told(frame(spark, rows))}
    assert verified == {r[0]: not (zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")) for r in rows}


def test_clashing_columns_and_long_text(spark):
    rows = [(1, "s", "en", 1, "y\n" * 500_000), (2, "s", "en", 1, "z")]
    df = frame(spark, rows)
    plain = told(df)
    extra = ["leaf", "root", "tree", "pos", "h", "path", "top", "block", "subroot", "__at", "LEAF2"]
    assert told(df.select("*", *[F.lit("x").alias(c) for c in extra])) == plain == brute(rows)


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    nodes = spark.range(5000).select(F.lit("s").alias("tree"), F.col("id").alias("pos"), F.md5(F.col("id").cast("string")).alias("h"))
    sizes = manifest._climb(nodes, 3, 4).groupBy("tree", "block").count()
    assert sizes.agg(F.max("count")).first()[0] == 81

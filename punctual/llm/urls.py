"""Allow and block rules on the addresses of pages, looked up through a blocked Bloom filter.

A rule is a host and the start of a path; it covers the host, its subdomains and every path that starts
so.  What can cover an address is few canonical keys: the ends of its host with as many labels as a listed
host has, each with the starts of its path that are as long as a listed one.  The keys of an address are
tested in the row against a blocked Bloom filter of the listed keys: one block of 256 bits a
key, all of whose bits come from one hash.  Rows without a possible hit are decided there and never
shuffled.  Of the others only the distinct sets of possible hits go to an exact hash join with the
list, which removes false positives; the longest rule that is left decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.session import staged

#: Bits a listed key (of which it sets 8), bits of a block, and blocks at most: the filter, a constant of the
#: plan, never has more than MAX_BLOCKS * 32 bytes.  Beyond that more keys pass it, and the join decides.
BITS_A_KEY = 16
BLOCK_BITS = 256
MAX_BLOCKS = 1 << 17
WORDS = BLOCK_BITS // 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between host and path of a key; a host holds no slash.
_SEPARATOR = "/"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://`` or for null."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The bits of a key in the words of its block, two in each, from one hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * word).bitwiseOR(bit(2 * word + 1)) for word in range(WORDS)]


def bloom_words(keys: DataFrame, blocks: int) -> list[int]:
    """The filter of the column ``key`` as 64-bit words, block after block; at most MAX_BLOCKS rows reach the driver."""
    words = keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))]
    )
    out = [0] * (blocks * WORDS)
    for row in words.collect():
        out[row["block"] * WORDS : (row["block"] + 1) * WORDS] = [row[f"w{i}"] for i in range(WORDS)]
    return out


def may_hold(words: Column, blocks: int, key: Column) -> Column:
    """Whether all bits of a key are set; true for every listed key."""
    at = _block(key, blocks) * WORDS
    found = F.lit(True)
    for i, mask in enumerate(_masks(key)):
        found = found & (F.get(words, at + i).bitwiseAND(mask) == mask)
    return found


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict.

    ``rules`` has text columns host, path and verdict (allow or block).  Of the rules that cover an address
    the longest wins (host and path together; of equally long ones that of the longer host); without
    one ``rule`` is null and the verdict ``default``, for what is not listed.  Of rules with equal host and path block wins.
    Hosts of rules are lower-cased; rules without a host, or with null in host, path or verdict, are left out.

    Null and empty addresses, and those without ``://``, have an empty host and path and no rule.  Repeated
    rows are judged alike, each is returned.  Columns of the pages named host, path, rule or verdict
    are replaced.  Empty tables of pages or rules are fine.  Work and memory do not depend on how often an
    address or a host occurs: rows are joined by their set of possible hits, of which each occurs once
    on the other side.
    """
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where(
        "host <> '' and path is not null and verdict is not null"
    )
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = staged(listed.select(
        F.concat("host", F.lit(_SEPARATOR), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"),
    ))
    # both sets are no larger than the longest listed path and host
    shape = listed.agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path_length")).alias("lengths"),
        F.sort_array(F.collect_set("labels")).alias("labels"),
    ).first()
    blocks = min(MAX_BLOCKS, max(1, -(-shape["n"] * BITS_A_KEY // BLOCK_BITS)))
    words = F.from_json(F.lit(json.dumps(bloom_words(listed, blocks))), "array<bigint>")

    host, path = host_and_path(F.col(url))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    numbers = lambda values: F.array(*[F.lit(n) for n in values]) if values else F.array().cast("array<int>")
    ends = F.array_distinct(F.transform(numbers(shape["labels"]), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)))
    lengths = F.filter(numbers(shape["lengths"]), lambda n: n <= F.length("path"))
    key = lambda end, n: F.concat(end, F.lit(_SEPARATOR), F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(ends, lambda end: F.transform(lengths, lambda n: key(end, n))))
    rows = rows.withColumn("__maybe", F.filter(keys, lambda k: may_hold(words, blocks, k)))

    some = rows.where(F.size("__maybe") > 0)
    sets = some.select("__maybe").distinct()
    exact = sets.select("__maybe", F.explode("__maybe").alias("key")).join(listed.hint("shuffle_hash"), "key")
    # longest first: by host and path together, then by host
    order = F.struct(F.length("rule"), F.length("rule") - F.col("path_length"))
    best = exact.groupBy("__maybe").agg(F.max_by(F.struct("rule", "verdict"), order).alias("__best"))
    judged = some.join(best, "__maybe", "left").select(*kept, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    rest = rows.where(F.size("__maybe") == 0).select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionAll(rest)

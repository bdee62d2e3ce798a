"""Registered queries of this subpackage: each operator over its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import (
    decontamination, extraction, language, manifest, mixing, negatives, neighbours, overlap, quality, repeats, sharding, surrogates, urls,
)
from punctual.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = 8191
#: In use, a secret of whoever runs the job: with it a surrogate can be drawn again.
SURROGATE_KEY = b"replace this key before publishing anything"


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, text: str) -> None:
    ORACLES[name] = text.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@register
def op1_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return docs


@register
def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@register
def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = ~held_out(F.col("doc_id"))
    model = quality.fit(docs.where(seen), table(spark, sf_dir, "labels").where(seen))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "size_difference",
    )


@register
def op5_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    told = language.predict(docs, model, keep=["doc_id"])
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@register
def op6_two_pass_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@register
def op7_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = overlap.join(table(spark, sf_dir, "documents"), ngram=3, threshold=0.9)
    return docs.select("doc_id", "n_shingles", "component_id")


sql("op7_count_vector_join", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b USING (s) JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT r.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM reached r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
""")


@register
def op8_lookup_table_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


sql("op8_lookup_table_shards", f"""
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5(name || '/first'), 1, 15) AS BIGINT) % {SLOTS} AS first,
         CAST('0x' || substr(md5(name || '/step'), 1, 15) AS BIGINT) % ({SLOTS} - 1) + 1 AS step
  FROM (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({len(SHARDS)}) t(i))
),
orders AS (SELECT list(first ORDER BY i) AS firsts, list(step ORDER BY i) AS steps FROM shards),
turns AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, list_transform(range({SLOTS}), lambda x: true) AS free,
         list_transform(range({len(SHARDS)}), lambda x: CAST(0 AS BIGINT)) AS tried
  UNION ALL
  SELECT turn + 1, pick, list_concat(free[1:pick], [false], free[pick + 2:]),
         list_concat(tried[1:turn % {len(SHARDS)}], [j], tried[turn % {len(SHARDS)} + 2:])
  FROM (
    SELECT *, (firsts[turn % {len(SHARDS)} + 1] + j * steps[turn % {len(SHARDS)} + 1]) % {SLOTS} AS pick
    FROM (
      SELECT t.*, o.*, list_filter(range(tried[turn % {len(SHARDS)} + 1], {SLOTS}),
        lambda k: free[(firsts[turn % {len(SHARDS)} + 1] + k * steps[turn % {len(SHARDS)} + 1]) % {SLOTS} + 1])[1] AS j
      FROM turns t, orders o WHERE turn < {SLOTS}
    )
  )
),
owners AS (
  SELECT slot, 'shard-' || lpad(CAST((turn - 1) % {len(SHARDS)} AS VARCHAR), 3, '0') AS shard FROM turns WHERE turn > 0
)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, shard
FROM (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents
) JOIN owners USING (slot)
""")


@register
def op9_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken",
        F.size("slots").cast("long").alias("n_slots"), F.coalesce(F.array_min("slots"), F.lit(-1)).alias("first_slot"),
        F.coalesce(F.array_max("slots"), F.lit(-1)).alias("last_slot"),
    )


# what is taken of a document follows from its place alone; when it is taken follows from the golden-ratio points
sql("op9_low_discrepancy_mix", """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w
  FROM rows GROUP BY source
),
capped AS (
  SELECT source, source_size, w, false AS filled, 0 AS round FROM sources
  UNION ALL
  SELECT source, source_size, w, filled OR w * level > 2 * source_size, round + 1
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - sum(CASE WHEN filled THEN 2 * source_size ELSE 0 END) OVER ())
              / sum(CASE WHEN filled THEN 0 ELSE w END) OVER () AS level
    FROM capped WHERE round < 40
  )
),
targets AS (
  SELECT source, source_size, CASE WHEN filled THEN 2.0 * source_size ELSE
           w * (1.5 * sum(source_size) OVER () - sum(CASE WHEN filled THEN 2 * source_size ELSE 0 END) OVER ())
             / sum(CASE WHEN filled THEN 0 ELSE w END) OVER () END AS target
  FROM capped WHERE round = 40
),
placed AS (
  SELECT row_number() OVER () AS n, doc_id, r.source, size, source_size, target, CAST(round(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
),
turns AS (
  SELECT source, source_size, goal, CAST(ceil(goal / 512.0) AS BIGINT) AS turns, row_number() OVER (ORDER BY source IS NULL, source) AS k
  FROM (SELECT source, source_size, CAST(round(target) AS BIGINT) AS goal FROM targets) WHERE goal > 0
),
upper AS (
  SELECT *, sum(turns) OVER () AS all_turns,
         CAST(round(CAST(sum(turns) OVER (ORDER BY k) AS DOUBLE) / CAST(sum(turns) OVER () AS DOUBLE)
                    * (2147483648 - count(*) OVER ())) AS BIGINT) + k AS upto
  FROM turns
),
ranges AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY k), 0) AS since FROM upper),
points AS (
  SELECT i, i % 2147483648 * 1327217885 % 2147483648 AS spot
  FROM (SELECT unnest(range((SELECT CAST(max(ceil((turns + log2(all_turns + 2) + 3) * 2147483648 / (upto - since))) AS BIGINT) FROM ranges))) AS i)
),
slots AS (
  SELECT i AS slot, source, source_size, goal, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS turn,
         CAST(ceil(source_size / 512.0) AS BIGINT) AS blocks
  FROM points JOIN ranges ON spot >= since AND spot < upto
),
takes AS (
  SELECT slot, source, turn % blocks AS block_no,
         least(512, source_size - turn % blocks * 512, goal - turn // blocks * source_size - turn % blocks * 512) AS words
  FROM slots
),
cut AS (SELECT n, source, start, size, unnest(range(start // 512, (start + size - 1) // 512 + 1)) AS block_no FROM placed WHERE size > 0),
pieces AS (
  SELECT n, count(*) AS n_slots, min(slot) AS first_slot, max(slot) AS last_slot
  FROM cut c JOIN takes t ON c.source IS NOT DISTINCT FROM t.source AND c.block_no = t.block_no
  WHERE least(words, start + size - c.block_no * 512) > greatest(start - c.block_no * 512, 0) GROUP BY n
)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
       CASE WHEN size = 0 THEN 0 ELSE
         goal // source_size * size + greatest(least(start + size, goal % source_size) - start, 0) END AS taken,
       coalesce(n_slots, 0) AS n_slots, coalesce(first_slot, -1) AS first_slot, coalesce(last_slot, -1) AS last_slot
FROM placed LEFT JOIN pieces USING (n)
""")


@register
def op10_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    stripped = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = manifest.leaf_of([*[F.col(f) for f in fields[:-1]], stripped])
    rows = manifest.manifest(docs, fields, "source", "doc_id", {"tampered": tampered})
    folded = manifest.fold(F.col("tampered"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _encoded_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


sql("op11_merkle_manifest", f"""
WITH RECURSIVE marked AS (
  SELECT *, coalesce(xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
                        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
         ), CAST(4294967295 AS BIGINT)) % 2 = 0, false) AS even
  FROM documents
),
hashed AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_encoded_sql("source")} AS tree, {_leaf_sql("text")} AS leaf,
         {_leaf_sql("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")} AS tampered
  FROM marked
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
),
nodes AS (
  SELECT 0 AS lvl, tree, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lvl + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY lvl, tree, pos // 3, n
),
groups AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes JOIN (SELECT DISTINCT tree, source FROM leaves) USING (tree) WHERE nodes.n = 1
),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM groups
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n
),
runs AS (
  SELECT lvl, tree, pos,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT lvl, tree, pos, h FROM nodes WHERE n > 1 UNION ALL SELECT lvl, NULL, pos, h FROM upper WHERE n > 1)
),
within AS (
  SELECT id, tree, n, lvl, pos, h, proof FROM (SELECT id, tree, n, 0 AS lvl, pos, tampered AS h, '' AS proof FROM leaves)
  UNION ALL
  SELECT w.id, w.tree, (w.n + 2) // 3, w.lvl + 1, w.pos // 3, sha256(before || w.h || after), proof || before || after
  FROM within w JOIN runs r ON w.tree = r.tree AND w.lvl = r.lvl AND w.pos = r.pos
),
above AS (
  SELECT w.id, g.n, 0 AS lvl, g.pos, w.h, w.proof FROM within w JOIN groups g USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT a.id, (a.n + 2) // 3, a.lvl + 1, a.pos // 3, sha256(before || a.h || after), proof || before || after
  FROM above a JOIN runs r ON r.tree IS NULL AND a.lvl = r.lvl AND a.pos = r.pos
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, a.h AS folded_root, a.h = root AS verified
FROM leaves JOIN groups USING (tree) JOIN above a ON a.id = leaves.id AND a.n = 1, (SELECT h AS root FROM upper WHERE n = 1)
""")


@register
def op12_residue_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


sql("op12_residue_hard_negatives", """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
""")

_RULES = """
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')"""


@register
def op13_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM ({_RULES}) AS t(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


sql("op13_blocked_bloom_urls", f"""
WITH rules(host, path, verdict) AS ({_RULES}),
parts AS (
  SELECT row_number() OVER () AS id, page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
)
SELECT page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
""")

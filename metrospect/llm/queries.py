"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrospect.llm import (
    byte_bpe, chat_format, cover_tree, fill_middle, hard_negatives, hnsw, mixing, secret_scan,
    sentence_pieces, sharding, simhash, substring_dedup, toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(*chat_format.tree(rows.unionByName(extra)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_first_use(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


def op10_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before
  FROM w
  WINDOW o AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * (weights - weight_before) <= weight * (total - cap_before) AS is_full FROM f),
h AS (
  SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)::BIGINT AS cap_full,
         coalesce(sum(weight) FILTER (WHERE is_full) OVER (), 0)::BIGINT AS weight_full
  FROM g),
t AS (
  SELECT source, source_size, weight,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE weight::DOUBLE * (total - cap_full)::DOUBLE / (weights - weight_full)::DOUBLE END AS target
  FROM h),
u AS (SELECT *, floor(target + 0.5)::BIGINT AS wanted FROM t),
v AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.wanted, 2.0 - u.weight / 2.0 AS height, u.weight - 2.0 AS slope,
         CASE WHEN u.source_size = 0 THEN 0 ELSE u.wanted // u.source_size END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
y AS (
  SELECT *, CASE WHEN whole > 0 THEN size ELSE greatest(0, least(size, wanted - start)) END AS words FROM v),
x AS (
  SELECT *, CASE WHEN words > 0 THEN (start + words / 2.0::DOUBLE) / wanted::DOUBLE END AS share FROM y)
SELECT doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, wanted - whole * source_size - start)))::BIGINT AS taken,
       round(2.0::DOUBLE * share / (height::DOUBLE + sqrt(height::DOUBLE * height::DOUBLE + 2.0::DOUBLE * slope::DOUBLE * share)), 9)
         AS first_position
FROM x
"""

REGISTRY = {f.__name__: f for f in (
    op1_toxicity, op2_cover_tree, op3_prefix_tree_chat, op4_byte_bpe, op5_virtual_slots, op6_simhash,
    op7_suffix_automata, op8_hnsw, op9_curriculum_mix, op10_secret_formats, op11_fill_middle,
    op12_sentence_pieces, op13_hard_negatives)}
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1,
         ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
o AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM p WHERE alike),
n AS (
  SELECT o.anchor_id, o.positive_id, p.vec_id AS negative_id, o.positive_score, p.score AS negative_score,
         row_number() OVER (PARTITION BY o.anchor_id, o.positive_id ORDER BY p.score DESC, p.vec_id)::INTEGER AS rank
  FROM o JOIN p ON o.anchor_id = p.anchor_id AND o.place <= 5 AND NOT p.alike
    AND 30 * o.positive_score <= 100 * p.score AND 100 * p.score <= 90 * o.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE = {
    "op2_cover_tree": OP2_SQL, "op9_curriculum_mix": OP9_SQL, "op11_fill_middle": OP11_SQL, "op13_hard_negatives": OP13_SQL}

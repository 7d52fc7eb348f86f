"""Registered queries of the operators and their DuckDB SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger.llm import (decontam, exact, mixing, negatives, ngram_join, pieces, quality, secrets, sharding, substring, tokens,
                           toxicity, whitening)
from satledger.llm.common import read_table


def op1_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scores.select("doc.doc_id", (toxicity.remainder(F.col("doc.doc_id"), 3) == 1).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(read_table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scores.select("doc.doc_id", (toxicity.remainder(F.col("doc.doc_id"), 4) == 2).alias("held_out"),
                         F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op4_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = decontam.hit_words()
    return found.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(read_table(spark, sf_dir, "documents"))
    return shards.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", tokens.sample_edits().alias("edits"))
    return tokens.recounted(docs).withColumnRenamed("id", "doc_id")


def op8_grace_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.duplicate_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    digest = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in secrets.BASE),
                        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"),
                        F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"))


def op10_partenum_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar_groups(read_table(spark, sf_dir, "documents"), words=3, percent=90)
    return groups.withColumnRenamed("id", "doc_id")


def op11_merge_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = ids.select("doc_id", pieces.n_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return pieces.decoded(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(read_table(spark, sf_dir, "embeddings"), components=8)
    each = rows.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return each.select(F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n",
                       F.col("deviation").try_cast("bigint").alias("deviation"), F.col("c.whitened").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")


def op13_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, label=label)


QUERIES = {f.__name__: f for f in (
    op1_weak_supervision_toxicity,
    op2_cube_mixing,
    op3_compression_quality,
    op4_suffix_automaton_decontamination,
    op5_columnwise_suffix_dedup,
    op6_byte_shards,
    op7_edit_aware_token_counts,
    op8_grace_hash_dedup,
    op9_secret_ownership,
    op10_partenum_ngram_join,
    op11_merge_table_pieces,
    op12_polarisation_whitening,
    op13_slot_hard_negatives,
)}

SQL = {
    "op8_grace_hash_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_slot_hard_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same,
                   list_dot_product(a.x, b.x)::BIGINT AS score
            FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        negatives AS (
            SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
            FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM negatives WHERE place <= 3
    """,
}

"""The registered query of each operator, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import centroids, conversations, hmm, langid, line_dedup, mixing, quality, secrets, toxicity
from gleanery.llm.embedding_dup import near_vectors
from gleanery.llm.near_dup import near_classes
from gleanery.llm.packing import pack, pieces
from gleanery.llm.token_counts import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.mark_lines(documents(spark, sf_dir), tau=2, min_chars=40)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept", F.array_join("removed_lines", ",").alias("removed_lines"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean_lines(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "n_failed_lines", "lost_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.is_held_out())
    out = langid.identify(docs, langid.fit(docs.where("NOT held_out")))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir), similarity=0.8, words=5).select("doc_id", "class_id", "kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2), size=1024)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return hmm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir), pattern=secrets.WHOLE)
    return out.select("doc_id", "start", F.length("c").cast("long").alias("length"), F.md5("c").alias("digest"), "score", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, scale=64, dim=64, seed="1")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.is_held_out("doc_id", 4, 2)
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.fit(docs.where("NOT held_out"), labels.where(~held_out)))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"].alias("score"), (-s["start"]).alias("start"), s["length"].alias("length"))))
    out = out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"), worst.alias("w"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", (-F.col("w.start")).alias("worst_start"), F.col("w.length").alias("worst_length"), F.col("w.score").alias("worst_score"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dup": op4_minhash_near_dup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_near_dup": op7_embedding_near_dup,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op12_conversation_repair": conversations.ORACLE_SQL,
}

"""The queries of this folder's operators, and their SQL where DuckDB can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, hard_negatives, license_scan, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(_read(spark, sf_dir, "conversations"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir)).drop("bucket")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir), _read(spark, sf_dir, "labels")
    domain = mixing.domain_of(F.col("quality"), F.col("toxic"))
    models = mixing.fit_domains(docs, labels, domain, len(mixing.DOMAINS))
    return mixing.mix(docs, models, [mixing.TARGETS[d] for d in mixing.DOMAINS], keep=["doc_id"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(_read(spark, sf_dir), shards=16)
    return out.select("row.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(_read(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(_read(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    return quality_classifier.classify(docs, quality_classifier.fit(docs, _read(spark, sf_dir, "labels")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels"))).drop("difference")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_chat_formatting, op3_exact_dedup, op4_mixing, op5_quality_rules, op6_sharding, op7_license_scans, op8_byte_level_bpe, op9_pii, op10_quality_classifier,
        op11_embedding_whitening, op12_hard_negatives, op13_toxicity,
    )
}

_NORM = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

ORACLE = {
    "op2_chat_formatting": chat.ORACLE,
    "op5_quality_rules": quality_rules.oracle(),
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, {_NORM} AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-cp, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
}

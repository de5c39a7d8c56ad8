"""Corpus pipeline: from raw documents to token ids, five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; its
result is written as Parquet and read again as the next one's documents. All stages but the last
return the columns of documents.

1. quality_classifier: rows that the classifier rejects go.
2. exact_dedup: of equal texts one row stays.
3. ngram_jaccard_join: of each component of near copies the row of least id stays (null ids last).
4. mixing: rates, at most 1, bring expected domain tokens towards the targets; a row of rate r stays
   with chance r by a seeded hash of its id and text, so rows of the lead domain stay. Domains with
   fewer tokens than their target stay short: a rate of at most 1 makes no copies.
5. byte_level_bpe: the texts as token ids.

Defined results: verdicts name rows by id and text, so null and repeated ids are as good as others,
and of rows equal in both one is as good as another; a null text is an empty text; an empty table
goes through empty; extra columns stay, of whatever name, to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, common, exact_dedup, mixing, ngram_join, quality_classifier


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, _labels(spark, sf_dir)))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = mixing.fit_domains(docs, _labels(spark, sf_dir), mixing.domain_of(F.col("quality"), F.col("toxic")), len(mixing.DOMAINS))
    key = common.text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", key.alias("key"))
    rates = mixing.mix(rows, models, [mixing.TARGETS[d] for d in mixing.DOMAINS], keep=["id", "key"], max_rate=1.0)
    names = rates.groupBy("id", "key").agg(F.max("copies").alias("copies"), F.count("*").alias("n"))
    names = names.select("id", "key", F.when(F.col("copies") > 0, F.col("n")).otherwise(0).alias("stay"), "n")
    return common.keep_named(docs, names, F.col("doc_id"), key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_one_copy),
    ("ngram_jaccard_join", keep_one_near_copy),
    ("mixing", mix),
    ("byte_level_bpe", encode),
]

#: SQL has no trained models and no merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.Scratch(spark) as s:
        for i, (_, stage) in enumerate(STAGES):
            docs = s.write(stage(spark, docs, sf_dir), keep=i == len(STAGES) - 1)
    return docs

"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyscale.llm import bpe_replay, common, decontaminate, line_dedup, quality_rules, simhash_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; ``n_chars`` follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group: that of the smallest ``doc_id``, null ids last, then of the smallest text hash; of rows
    that repeat both, the first by the other columns. One whose text is all gone stays only if its group is that kind."""
    key = ["none", "id", "body"]
    keyed = docs.select(*COLUMNS, F.explode(F.array(simhash_groups.row_key())).alias("k")).select(*COLUMNS, "k.*")
    left = keyed.join(simhash_groups.representatives(docs), key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy("lang", "source", "n_chars"))
    return left.withColumn("nth", first).where("nth = 1").select(COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked to decode to its text."""
    coded = bpe_replay.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.hex("ids").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates),
          ("benchmark decontamination", benchmarks), ("token ids", token_ids)]

#: SimHash and token ids have no SQL; ``tests/llm`` compares every stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs

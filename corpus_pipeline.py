"""From raw documents to training input: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import common, langid, mixing, pieces, secretscan, simhash

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secret_scan", secretscan.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL can't express the classifier, the balanced sample or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with common.scratch(spark):  # what the stage wrote on its way goes once its result is written
            docs = common.materialize(stage(spark, before, sf_dir), spark, 1)
        common.discard(before, spark)
    return docs

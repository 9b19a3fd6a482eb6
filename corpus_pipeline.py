"""From raw documents to token ids: five stages, each of which works on all that the one before has kept.

quality       documents that the classifier rejects go
line_dedup    repeated chunks of lines are cut out of the texts; n_chars follows
near_dedup    one document of each SimHash component stays
decontaminate documents that overlap with a benchmark item go
bpe           ids of every text, and the text that they decode to

Null and empty texts pass the stages as their operators say (a null text stays null, and is decoded as an empty one); repeated rows are
documents of their own until near_dedup keeps one of them; null ids are kept; empty tables give empty results; further columns of
documents come through, whatever their names; a text of any length is one text.

All but the last return the columns of documents. SQL cannot express the stages (learned model, content-defined
chunks, 64-bit XXH64 fingerprints, spaced seeds, BPE), so ORACLE_SQL is None and tests/llm compares each
stage with a plain version on a small fixture.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from ledgerloom.llm.common import quoted, stored, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.deduplicated(docs, is_table=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[quoted(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, is_table=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

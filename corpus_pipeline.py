"""The corpus pipeline: raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import jaccard, mixing, packing, repeats, toxicity
from graphmill.llm.common import cut

#: Bytes from which the pipeline takes a repeated passage out: some twenty words, so that set
#: phrases and short lines of clean documents stay.
PASSAGE_BYTES = 100


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; repeated rows are judged alike, null texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays; of rows that repeat it and its text, one. Rows without an id stay."""
    return jaccard.drop_near_duplicates(docs, jaccard.Params(width=5, num=80, den=100))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts; every row stays, repeated ones alike, null texts as empty ones."""
    return repeats.clean_documents(docs, repeats.Params(length=PASSAGE_BYTES, first=48), columns=tuple(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights; rows that repeat an id draw alike."""
    return mixing.mix(docs, columns=tuple(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences; each row is packed on its own, null texts are the end token alone."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard", jaccard_stage), ("suffix_dedup", repeats_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Learned scores and byte-level repeats are beyond SQL; tests/llm/test_pipeline.py works out the whole in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; lineage is cut after each, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

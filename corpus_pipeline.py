"""A training corpus from raw documents: five stages, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.llm.common import Scratch, table
from echoloom.llm.mixing import mix_documents
from echoloom.llm.packing import pack
from echoloom.llm.quality import filter_quality
from echoloom.llm.simhash import drop_near_duplicates
from echoloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels that aren't held out, doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules together call good."""
    return filter_quality(docs)


def simhash_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of op1, that of the smallest doc_id: fingerprints of four-word shingles at 4 bits or fewer.

    That is equal texts and copies that differ in very little, not all texts of a similarity of 0.8 (see the README).
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("simhash_copies", simhash_copies), ("mixing", mixing), ("packing", packing)]

#: Trees, dependent rounding and tokens can't be put in SQL; tests/llm/test_pipeline.py holds each stage's decisions against
#: those of its operator on the same rows (near-duplicates against a plain version), the operators' own tests against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written to the shared scratch folder and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{number}_{name}")
        if number > 1:
            scratch.drop(f"{number - 1}_{STAGES[number - 1][0]}")
    return docs

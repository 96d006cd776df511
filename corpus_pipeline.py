"""A training corpus from raw documents, in five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. Between stages rows are written to the shared folder, so that a lost executor costs at most
a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remitspark.llm.common import Scratch
from remitspark.llm.jaccard import drop_similar
from remitspark.llm.mixing import mixed_documents
from remitspark.llm.piece_bpe import default_path, digests
from remitspark.llm.suffix_array import cut_repeats
from remitspark.llm.toxicity import reject_toxic


#: Bytes of a repeat that the suffix_array stage cuts: of 1000 runs of 51 words in the test tables about 10 are shorter.
PASSAGE = 240


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance classifier rejects go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash and MinHash find them, a Jaccard similarity of 0.8 or more
    of their sets of five-word shingles confirms them."""
    return drop_similar(docs, shingle=5, least=0.8)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that occur twice are cut from the texts, in all their places."""
    return cut_repeats(docs, PASSAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, each document as often as it is taken."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return digests(docs, default_path())


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("suffix_array", suffix_array), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Training, fingerprints, suffix order and tokenisation are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's rows are saved, and the table saved before goes once nothing reads it."""
    scratch = Scratch(spark, "pipeline")
    docs, saved = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if saved is not None:
            scratch.drop(saved)
        saved = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlint.llm._common import Scratch
from loomlint.llm.mixing import mixed_documents
from loomlint.llm.packing import pack_documents
from loomlint.llm.quality import kept_documents, train
from loomlint.llm.simhash import one_of_each
from loomlint.llm.substrings import remove_spans, repeated_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all of them, rejects go."""
    return kept_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints within 2 bits, or 5-word Jaccard similarity of 0.8) the smallest doc_id stays.

    Rows are told apart by doc_id and text; of wholly equal rows one stays.
    """
    return one_of_each(docs, similarity=0.8, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document keeps are cut from the others; every row stays."""
    return remove_spans(docs, repeated_spans(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; a document comes once for each pass that takes words of it, with the words taken."""
    return mixed_documents(docs, block_words=1024)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]
#: The classifier, the permutations and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

"""A cleaning pipeline over documents, each stage one operator of gridloom.llm.

Null texts count as empty ones and stay, but for copies of each other; rows with a null doc_id go only as
copies of rows that have one; repeated rows are one document and stay or go together; other columns stay
as they are until the packing, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from gridloom.llm import packing, simhash, substring, toxicity
from gridloom.llm.common import materialize, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of docs."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of five-word-shingle similarity of 0.8 or more."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of 35 words or more that recur goes; texts that lose nothing stay as they are.

    Kept words are joined by one blank, n_chars is counted anew; a text that is nothing but repeats
    stays as an empty one.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    left = substring.substring_dedup(docs, carry=others, as_is=True)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("other.n_chars"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": chars}
    return left.select(*[new[c].alias(c) if c in new else F.col("other")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]
#: Tokenizers, boosted trees and SimHash are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's rows written and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token output. Part of traceloom.llm.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. run() writes what each returns as Parquet
in the folder the executors share and reads it again, so a stage's lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.classify import fold
from traceloom.llm.common import table, written
from traceloom.llm.decontaminate import remove_contaminated
from traceloom.llm.mixing import mixed
from traceloom.llm.near_dup import without_near_duplicates
from traceloom.llm.queries import CUT, END_ID, tokenizer_path
from traceloom.llm.token_output import token_output
from traceloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score CUT or more go. Learns from the labelled rows that op7 learns from."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    return without_toxic(docs, labels.select("doc_id", "toxic"), CUT)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose five-word shingles are 0.8 alike one row stays, of least doc_id; rows of null doc_id stay."""
    return without_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item, or a whole shorter item, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows of null or shared doc_id are taken as their own."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids of what is left and returns a row for each document, read back from the files."""
    return token_output(docs, tokenizer_path(), END_ID, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near-dup", near_dup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs

"""From raw documents to token files: quality, near-duplicates, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochfold.llm import common, decontaminate, mixing, near_copies, quality, token_files
from epochfold.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, doesn't reject (score 0.3 or more)."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep_good(docs, quality.train(docs.select("doc_id", "text"), labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity 0.8 or more on sets of five-word shingles."""
    return near_copies.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of similarity 0.8 or more to a benchmark item, on five-word shingles."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled within its shards."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, in order of doc_id, and what they hold for each row."""
    return token_files.through_files(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", good_quality), ("simhash", one_of_each), ("decontamination", without_leaks), ("mixing", mixed), ("tokens", tokens)]

#: A fitted classifier, near copies and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

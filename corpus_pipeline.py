"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages take null and empty texts, null ids, repeated rows, an empty table and extra columns of any name; all but the last
return their rows with the columns of documents as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import mixing, near_dedup, template_decontamination, token_files, toxicity
from parcelflow.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject; it learns from the labelled ones among docs.

    Null and empty texts are scored like texts without words; without labels of both kinds the share of toxic labels decides;
    each of several equal rows meets the same end.
    """
    return toxicity.without_toxic(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chosen-path similarity links, the one with the smallest id.

    Of rows with one id one stays, the least by its text; rows with a null id and texts without words all stay.
    """
    return near_dedup.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with other values in its slots.

    Rows with a null id and null or empty texts stay; repeated rows meet the same end.
    """
    return template_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked weights of source, language and topic.

    Rows with a null id or without tokens are not sampled; nulls in a margin are a value of their own; rows with one id share
    their fate.
    """
    return mixing.sample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' index, as read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone; null ids come first; repeated rows are documents of their own.
    """
    return token_files.token_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL cannot express the string-kernel machine or the tokenizer. Tests compare near_duplicates and mixing with plain forms of the same
#: rules, tokens with the library's ids of whole texts, toxicity with its model's scores of single texts, and benchmark_leaks with the
#: operator's own hits, which another test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

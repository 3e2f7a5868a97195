"""A training-data pipeline over `documents`, each stage one operator applied to all that the stage before kept.

Stages return the columns of documents; the last returns one row a document of the written token files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import decontam, mixing, neardup, tokens, toxicity
from quillstack.llm.common import fold, read, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null, empty and wordless texts are read as empty words and stay; repeated rows are judged alike; without labels of both
    kinds nothing goes unless most labels are 1. Extra columns stay as they are.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each class of near copies.

    Null and empty texts are one class; null ids come last; of rows equal in id and text one stays; unlike texts under one id
    all stay. Texts of any length are compared whole. Extra columns stay as they are.
    """
    return neardup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half or more.

    Null and empty texts stay; null and empty items match nothing; repeated rows are judged alike. Extra columns stay as they are.
    """
    return decontam.clean(docs, decontam.indexes(read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (at most twice), in the order of its shards.

    Null sources are one source, the last; texts without words come with whole passes of their source alone; rows equal in id
    and text go together. Extra columns stay as they are.
    """
    return mixing.mixed(docs, mixing.plan(docs), "__shard", "__place").select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' own account of each document: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; null ids come last; repeated rows follow one another.
    """
    return tokens.read_tokens(tokens.write_tokens(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Learned scores and signatures can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}", compression="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)

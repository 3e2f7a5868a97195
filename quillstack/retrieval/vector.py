"""Vector retrieval: dot products, each document's best chunk, top-k with evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.vectors import dot
from quillstack.operators.chunks import positioned
from quillstack.retrieval.base import Retrieval

EVIDENCE = 500


def scored(chunks: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """chunks with `score` against one query vector, a literal of fixed size."""
    return chunks.withColumn("score", dot(F.col(embedding), F.array(*(F.lit(float(x)) for x in query))))


def scored_many(chunks: DataFrame, queries: DataFrame, embedding: str = "embedding", vector: str = "vector", most: int = 10_000) -> DataFrame:
    """Every stated query against every chunk. Queries are counted and broadcast in blocks of about `most`."""
    return reduce(DataFrame.union, [chunks.crossJoin(F.broadcast(q)).withColumn("score", dot(embedding, vector)).drop(vector) for q in blocks(queries, most)])


def blocks(df: DataFrame, most: int) -> list[DataFrame]:
    """df by the hash of its rows, in as many parts as leave about `most` rows in each; all of it if it is no larger."""
    n = -(-df.count() // most)
    return [df] if n <= 1 else [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k) for k in range(n)]


def max_pool(df: DataFrame, groups: list[str], score: Column | str, position: str, keep: list[str] = ()) -> DataFrame:
    """Each group's highest score and the first position that reaches it, in one partial aggregation."""
    score = F.col(score) if isinstance(score, str) else score
    best = F.max_by(F.struct(score.alias("score"), F.col(position).alias("best_pos"), *keep), F.struct(score, -F.col(position)))
    return df.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def ranked(df: DataFrame, groups: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """df with `rank` from 1 by falling score, ties by id; groups empty: one ranking of the whole table, numbered by ranges of it."""
    if not groups:
        return positioned(df, [F.desc(score), F.col(tie)], "rank", 1)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), tie)))


def top_k(df: DataFrame, groups: list[str], k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each group; without groups only the k rows that a top-k sort leaves are ranked, in one task."""
    if groups:
        return ranked(df, groups, score, tie).where(F.col("rank") <= k)
    return df.orderBy(F.desc(score), tie).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


class VectorRetriever:
    """chunks: doc_id, pos, text, embedding. encode gives a question's vector."""

    def __init__(self, chunks: DataFrame, encode: Callable[[str], list[float]], limit: int = 10):
        self.chunks, self.encode, self.limit = chunks, encode, limit

    def rank(self, chunks: DataFrame, query: str, limit: int) -> DataFrame:
        pooled = max_pool(scored(chunks, self.encode(query)), ["doc_id"], "score", "pos", ["text"])
        return top_k(pooled, [], limit).select("doc_id", "rank", "score", F.struct(F.col("best_pos"), F.substring("text", 1, EVIDENCE).alias("passage")).alias("evidence"))

    def retrieve(self, query: str) -> Retrieval:
        return Retrieval(query, "vector", self.rank(self.chunks, query, self.limit), ["text"], {"limit": self.limit})

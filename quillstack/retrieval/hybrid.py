"""Hybrid retrieval: filter by conditions, then rank by vectors, with explicit paths and integrity checks.

Path A: no conditions, the vector ranking of all. Path B: conditions that no document meets, nothing. Path C: the
chunks of the documents that meet them, ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.hashing import fingerprint
from quillstack.retrieval.base import Retrieval
from quillstack.retrieval.structured import StructuredRetriever
from quillstack.retrieval.vector import VectorRetriever


class HybridIntegrityError(RuntimeError):
    pass


def missing(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, side) of keys that one side lacks."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return l.join(r, key, "full").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("side"))


def check_ids(df: DataFrame, key: str = "doc_id") -> None:
    told = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.count_if(F.col(key).isNull()).alias("z")).first()
    if told["z"] or told["d"] != told["n"]:
        raise HybridIntegrityError(f"{told['z']} null and {told['n'] - told['d'] - told['z']} repeated ids")


class HybridRetriever:
    def __init__(self, structured: StructuredRetriever, vector: VectorRetriever):
        self.structured, self.vector = structured, vector

    @classmethod
    def from_artifacts(cls, selection: DataFrame, chunks: DataFrame, meta: dict, structured: StructuredRetriever, vector: VectorRetriever, recorded: str | None = None) -> HybridRetriever:
        """Only for a selection that is the recorded and the indexed one, with the same documents on both sides."""
        own = fingerprint(selection)
        if recorded is not None and own != recorded or meta.get("selection_fingerprint") != own:
            raise HybridIntegrityError("the selection, its manifest and the index don't belong together")
        check_ids(selection)
        apart = difference(selection, chunks).groupBy("side").count().collect()
        if apart:
            raise HybridIntegrityError(str({r["side"]: r["count"] for r in apart}))
        return cls(structured, vector)

    def retrieve(self, query: str) -> Retrieval:
        rows, found = self.structured.select(query)
        v, told = self.vector, {"conditions": found}
        if not found:
            return Retrieval(query, "hybrid", v.rank(v.chunks, query, v.limit), ["text"], told | {"path": "A"})
        candidates = rows.select("doc_id").distinct()
        n = candidates.count()
        if not n:
            return Retrieval(query, "hybrid", v.rank(v.chunks.limit(0), query, v.limit), list(found), told | {"path": "B", "n_candidates": 0})
        if not missing(candidates, v.chunks).isEmpty():
            raise HybridIntegrityError("candidates without chunks")
        return Retrieval(query, "hybrid", v.rank(v.chunks.join(candidates, "doc_id", "left_semi"), query, v.limit), [*found, "text"], told | {"path": "C", "n_candidates": n})


def paths(scores: DataFrame, conditions: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, path) for a batch: scores(query_id, doc_id, score), conditions(query_id, n), candidates(query_id, doc_id).

    One guarded branch a path, no action on the driver; path B leaves no rows.
    """
    n = conditions.groupBy("query_id").agg(F.sum("n").alias("n_conditions"))
    told = queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_conditions", F.lit(0)).alias("n_conditions"))
    free = scores.join(told.where("n_conditions = 0").select("query_id"), "query_id", "left_semi").withColumn("path", F.lit("A"))
    bound = scores.join(candidates, ["query_id", "doc_id"], "left_semi").join(told.where("n_conditions > 0").select("query_id"), "query_id", "left_semi").withColumn("path", F.lit("C"))
    return free.unionByName(bound)

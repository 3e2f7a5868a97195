"""Bounded judgment sets: the union of short rankings, a strict universe and references, with every origin told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.text import fold_evaluation, shown_value

KEYS = ["need_id", "doc_id"]
CAP, TOP, DEPTH, BROAD = 67, 5, 50, 0.5


class JudgmentCapExceeded(RuntimeError):
    """More pairs than the cap; nothing was written."""

    def __init__(self, total: int, cap: int, by_need: dict):
        super().__init__(f"{total} pairs exceed {cap}: {by_need}")
        self.total, self.cap, self.by_need = total, cap, by_need


def strict_universe(corpus: DataFrame, tests: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """doc_id of the documents that pass every test (field, phrases, words): the folded field holds a phrase or has a word by itself."""
    out = corpus
    for field, phrases, words in tests:
        text = fold_evaluation(field)
        hit: Column = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        for w in words:
            hit = hit | text.rlike(rf"\b{w}\b")
        out = out.where(hit)
    return out.select("doc_id")


def sources(top: DataFrame, universe: DataFrame, references: DataFrame) -> DataFrame:
    """(need_id, doc_id, is_top_vector, is_top_hybrid, is_strict, is_reference, formulations) from top(need_id, formulation, architecture,
    doc_id), universe(need_id, doc_id) and references(need_id, doc_id): one union and one aggregation."""
    no = F.lit(False)
    rows = top.select(*KEYS, "formulation", (F.col("architecture") == "vector").alias("v"), (F.col("architecture") == "hybrid").alias("h"), no.alias("u"), no.alias("r"))
    rows = rows.unionByName(universe.select(*KEYS, F.lit(None).cast("string").alias("formulation"), no.alias("v"), no.alias("h"), F.lit(True).alias("u"), no.alias("r")))
    rows = rows.unionByName(references.select(*KEYS, F.lit(None).cast("string").alias("formulation"), no.alias("v"), no.alias("h"), no.alias("u"), F.lit(True).alias("r")))
    return rows.groupBy(*KEYS).agg(F.bool_or("v").alias("is_top_vector"), F.bool_or("h").alias("is_top_hybrid"), F.bool_or("u").alias("is_strict"), F.bool_or("r").alias("is_reference"), F.array_sort(F.collect_set("formulation")).alias("formulations"))


def known_references(references: DataFrame, corpus: DataFrame) -> DataFrame:
    """references with `in_corpus`; absent documents are told, never invented."""
    return references.join(corpus.select("doc_id").distinct().withColumn("__in", F.lit(True)), "doc_id", "left").withColumn("in_corpus", F.coalesce("__in", F.lit(False))).drop("__in")


def overlaps(origins: DataFrame) -> DataFrame:
    v, h, u, r = (F.col(c) for c in ("is_top_vector", "is_top_hybrid", "is_strict", "is_reference"))
    return origins.agg(F.count_if(v & h).alias("n_vector_hybrid"), F.count_if((v | h) & u).alias("n_top_strict"), F.count_if((v | h) & r).alias("n_top_reference"), F.count_if(u & r).alias("n_strict_reference"))


def source_counts(origins: DataFrame) -> DataFrame:
    """(need_id, n_pairs, and for each source how many pairs it gave); a pair counts for each of its sources."""
    flags = ("is_top_vector", "is_top_hybrid", "is_strict", "is_reference")
    return origins.groupBy("need_id").agg(F.count("*").alias("n_pairs"), *(F.count_if(f).alias(f"n{f.removeprefix('is')}") for f in flags))


def repeated_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bounded(origins: DataFrame, cap: int = CAP) -> DataFrame:
    """origins, if they are at most the cap and no pair repeats."""
    if not repeated_pairs(origins, KEYS).isEmpty():
        raise ValueError("a pair occurs twice")
    by_need = {r["need_id"]: r["n"] for r in origins.groupBy("need_id").agg(F.count("*").alias("n")).collect()}
    if (total := sum(by_need.values())) > cap:
        raise JudgmentCapExceeded(total, cap, by_need)
    return origins


def broad_sets(sets: DataFrame, n_corpus: int, share: float = BROAD) -> DataFrame:
    """(need_id, formulation, n, is_broad)"""
    return sets.groupBy("need_id", "formulation").agg(F.count("doc_id").alias("n")).withColumn("is_broad", (F.col("n") > 0) & (F.col("n") >= share * n_corpus))


def batches(pairs: DataFrame, size: int = 5) -> DataFrame:
    """Blind batches: pairs alone, each once, numbered by id within their need; nothing tells where they come from."""
    turn = F.row_number().over(Window.partitionBy("need_id").orderBy("doc_id"))
    return pairs.select(*KEYS).distinct().withColumn("turn", turn).withColumn("batch", F.ceil(F.col("turn") / size).cast("int"))


def with_documents(pairs: DataFrame, corpus: DataFrame, columns: list[str], excerpt: int = 2500, absent: str = "(outside the selection)") -> DataFrame:
    """pairs with excerpts of each document's fields, as shown values, and their whole lengths (column__length); a placeholder where the document isn't there."""
    known = corpus.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    first = known.groupBy("doc_id").agg(*(F.min(shown_value(F.col(c).cast("string"))).alias(c) for c in columns), F.lit(True).alias("__in"))
    cells = [x for c in columns for x in (F.when(F.col("__in"), F.substring(c, 1, excerpt)).otherwise(absent).alias(c), F.length(c).alias(f"{c}__length"))]
    return pairs.join(first, "doc_id", "left").select(*pairs.columns, *cells)


def register(pairs: DataFrame) -> DataFrame:
    """A blank register of decisions."""
    return pairs.select(*KEYS, F.lit("PENDING").alias("decision"), *(F.lit("").alias(c) for c in ("evidence", "reviewer", "decided_on")))

"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop

#: Links that one task takes. Tables of up to so many links stay in one partition, where no step shuffles.
LINKS_A_TASK = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links between a and b."""
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (lo == hi).all():
            return node, node[label]
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, least = least_labels(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["u", "v"])


def components(edges: DataFrame, each: int = LINKS_A_TASK, native: bool = False) -> DataFrame:
    """(node, class) of all nodes of edges(a, b), which are longs; the class is the component's least node. Links of a node to itself count for nothing.

    The links lie in as many partitions as their number asks for, whatever the corpus was dealt in, so a small table costs
    small steps. Each task contracts its own links to stars first (not if `native`: then DataFrame functions alone are
    used), and a table that fits one task is done. Else large and small stars alternate: each node's larger neighbours
    move to its least one, then its smaller ones, until nothing changes. Each step's table is deleted once the next is written.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(pairs.distinct() if native else pairs, "links")
    n = e.count()
    few = n <= each
    if not native:
        stars = (e.coalesce(1) if few else e.repartition(-(-n // each))).mapInArrow(_contracted, "u long, v long")
        if few:
            classes = cut(stars.toDF("node", "class"), "classes")
            drop(e)
            return classes
        after = cut(stars.where("u <> v").distinct(), "links")
        drop(e)
        e = after

    def held(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    seen = None
    while True:
        both = held(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = held(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = cut(small.distinct(), "links")
        drop(e)
        e = after
        now = held(e).agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            classes = cut(held(e.select(F.col("u").alias("node"), F.col("v").alias("class")).union(e.select(F.col("v").alias("node"), F.col("v").alias("class")))).distinct(), "classes")
            drop(e)
            return classes
        seen = now

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources share `ratio` of all words by weight, none above `most` times its own words; what is above is shared
again. Each source's documents are hashed into blocks; blocks in a keyed random order are its draws (whole passes
first, then part of a pass; in the last block whole documents are taken while they fit). A binary tree over the output
shards splits the vector of draws exactly: a node sends its left half a multivariate-hypergeometric part, as if all
draws were shuffled together and dealt out. Leaves take disjoint runs of each source's draws and shuffle locally.

There may be as many sources as documents: they, their blocks and draws stay in DataFrames. The tree on the driver splits
the quotas of at most GROUPS groups of sources (each a source while there are no more); within a group, whose draws are
exchangeable, a task deals them in a random order, which is the same hypergeometric split one level down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop, parts, read
from quillstack.operators.chunks import positioned

WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column | str = "text") -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) counts of draws whose columns sum to the quotas; rows differ by one draw at most for every level."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        take = int(own.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = _hypergeometric(rng, own, take)
        node(lo, mid, left)
        node(mid, hi, own - left)

    node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, own: np.ndarray, take: int) -> np.ndarray:
    """One multivariate-hypergeometric draw, source by source."""
    out, rest = np.zeros_like(own), int(own.sum())
    for i, n in enumerate(own.tolist()):
        rest -= n
        out[i] = rng.hypergeometric(n, rest, take) if n and take else 0
        take -= int(out[i])
    return out


#: Rows of a side that may be broadcast; a larger one is joined by key.
SMALL = 200_000
#: Groups of sources whose quotas the driver splits; within a group the tasks deal.
GROUPS = 1024


@dataclass
class Mixture:
    """A plan. sources: a row a source (__rank, source, words, target, __blocks); draws: a row a drawn block (__rank, __block,
    __passes: the shards of its whole passes, __part: the shard of its part); chosen: the rows that a part takes."""

    sources: DataFrame
    n_sources: int
    draws: DataFrame
    n_draws: int
    chosen: DataFrame
    n_chosen: int
    sized: DataFrame
    seed: int

    def assign(self, docs: DataFrame) -> DataFrame:
        """docs(source, __key) with __rank, words, target and __shards: the output shard of each time the mix takes the row (none, once or more often)."""
        out = _placed(docs, self.sources, self.n_sources).join(_if_small(self.draws, self.n_draws), ["__rank", "__block"], "left").join(_if_small(self.chosen, self.n_chosen), ["__rank", "__key"], "left")
        extra = F.when(F.col("__taken"), F.array("__part")).otherwise(F.array().cast("array<int>"))
        return out.withColumn("__shards", F.concat(F.coalesce("__passes", F.array().cast("array<int>")), extra)).drop("__passes", "__part", "__taken", "__block")


def _if_small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast where it has at most SMALL rows, all of them narrow."""
    return F.broadcast(df) if n <= SMALL else df


def _placed(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """docs with their source's row and __block; sources are matched null-safely."""
    known = sources.withColumnRenamed("source", "__source")
    return docs.join(_if_small(known, n), F.col("source").eqNullSafe(F.col("__source"))).withColumn("__block", F.pmod("__key", F.col("__blocks"))).drop("__source", "__blocks")


def key(seed: int) -> Column:
    """A row's place in all random orders: a keyed hash of its id and whole text, so reruns and other partitions agree."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def with_targets(ranked: DataFrame, weights: tuple[float, ...], ratio: float, most: float) -> DataFrame:
    """ranked(__rank, source, words) with `target`: shares of ratio * all words by weight, with what exceeds most * words shared again until none is above.

    In each round one sum over the sources by weight, so no source's row leaves its task.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    own = ranked.withColumn("__weight", weight)
    total = own.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("__weight") * F.lit(level) > F.col("words") * most
        # sums of whole numbers by weight: the same in any order
        rows = own.groupBy("__weight").agg(F.sum(F.when(is_full, F.col("words"))).alias("held"), F.count_if(is_full).alias("full"), F.count_if(~is_full).alias("free")).collect()
        now, free = sum(r["full"] for r in rows), sum(r["__weight"] * r["free"] for r in sorted(rows, key=lambda r: r["__weight"]))
        if now == full or not free:
            break
        full, level = now, (ratio * total - most * sum(r["held"] or 0 for r in rows)) / free
    target = F.lit(0.0) if level is None else F.when(F.col("__weight") * F.lit(level) > F.col("words") * most, F.col("words") * most).otherwise(F.col("__weight") * F.lit(level))
    return own.withColumn("target", target.cast("double")).drop("__weight")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 17, block_words: int = 8192, max_blocks: int = 1 << 16) -> Mixture:
    """Sources by code point, null last, weigh `weights` in turn. docs(doc_id, text, source); rows without words take part with size 0 and go with whole passes alone."""
    spark = docs.sparkSession
    shards = shards or parts(spark)
    sized = cut(docs.select("doc_id", "source", words().alias("size"), key(seed).alias("__key")), "sized")
    ranked = positioned(sized.groupBy("source").agg(F.sum("size").alias("words")), [F.col("source").asc_nulls_last()], "__rank").withColumn("__rank", F.col("__rank").cast("long"))
    sources = cut(with_targets(ranked, weights, ratio, most), "targets")
    n_sources, total = sources.count(), sources.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    each = max(block_words, -(-total // max_blocks), 1)
    blocks = cut(sources.withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / each)).cast("long")), "sources")
    drop(sources)
    placed = _placed(sized.select("source", "size", "__key"), blocks, n_sources)
    in_block = placed.groupBy("__rank", "__block").agg(F.sum("size").alias("held"), F.first("words").alias("words"), F.first("target").alias("target"))
    # a source's blocks in a keyed order, with the words before each; at most max_blocks of one source
    order = Window.partitionBy("__rank").orderBy(F.xxhash64(F.lit(seed), "__rank", "__block"), "__block")
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    turn = in_block.withColumns({"place": F.row_number().over(order), "before": F.sum("held").over(order) - F.col("held"), "passes": passes.cast("int")})
    left = F.round(F.col("target") - F.col("passes") * F.col("words")).cast("long") - F.col("before")
    turn = turn.withColumn("left", left)
    whole = F.col("passes") + F.when((F.col("held") <= F.col("left")) & (F.col("passes") * F.col("words") + F.col("held") > 0), 1).otherwise(0)
    part = F.when((F.col("held") > F.col("left")) & (F.col("left") > 0), F.col("left"))
    groups = max(1, min(n_sources, GROUPS))
    drawn = cut(turn.select((F.col("__rank") % groups).cast("int").alias("group"), "__rank", "__block", "place", whole.alias("whole"), part.alias("left")).where("whole > 0 or left is not null"), "drawn")
    quotas = np.zeros(groups, dtype=np.int64)
    for r in drawn.groupBy("group").agg(F.sum(F.col("whole") + F.when(F.col("left").isNull(), 0).otherwise(1)).alias("n")).collect():  # at most GROUPS rows
        quotas[r["group"]] = r["n"]
    counts = split(quotas, shards, seed)

    def deal(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The group's draws in a random order, dealt out as the tree's leaves have it."""
        group = group.sort_values(["__rank", "place"], kind="stable")
        turns = (group["whole"] + group["left"].notna()).to_numpy()
        own = np.repeat(np.arange(len(group)), turns)
        is_part = np.zeros(len(own), bool)
        is_part[(np.cumsum(turns) - 1)[group["left"].notna().to_numpy()]] = True
        where = np.empty(len(own), dtype=np.int64)
        where[np.random.default_rng([seed, int(name[0])]).permutation(len(own))] = np.repeat(np.arange(shards), counts[:, int(name[0])])
        begin = np.cumsum(turns) - turns
        passes = [sorted(where[b : b + n].tolist()) for b, n in zip(begin, group["whole"], strict=True)]
        parted = np.full(len(group), -1, dtype=np.int64)
        parted[own[is_part]] = where[is_part]
        return pd.DataFrame({"__rank": group["__rank"], "__block": group["__block"], "__passes": passes, "__part": pd.array([None if x < 0 else int(x) for x in parted], dtype="Int32")}, index=group.index)

    draws = cut(drawn.groupBy("group").applyInPandas(deal, "__rank long, __block long, __passes array<int>, __part int"), "draws")
    n_draws = draws.count()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        """Whole documents in key order while they fit what is left; equal rows go together."""
        same = group.sort_values("__key")
        left, taken = int(same["left"].iloc[0]), []
        for size in same["size"]:
            taken.append(size <= left)
            left -= int(size) if size <= left else 0
        return pd.DataFrame({"__rank": same["__rank"], "__key": same["__key"], "__taken": taken}).loc[lambda x: x["__taken"]]

    last = drawn.where("left is not null").select("__rank", "__block", "left")
    # one block of each source; rows that repeat are summed before, rows without words don't come
    rows = placed.where("size > 0").join(_if_small(last, n_sources), ["__rank", "__block"]).groupBy("__rank", "__key").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    chosen = cut(rows.groupBy("__rank").applyInPandas(fill, "__rank long, __key long, __taken boolean"), "chosen")
    drop(drawn)
    return Mixture(blocks, n_sources, draws, n_draws, chosen, chosen.count(), sized, seed)


def mixed(docs: DataFrame, mix: Mixture, shard: str = "shard", place: str = "place") -> DataFrame:
    """The mix itself: docs' rows as often as they are taken, with their shard and their place, a rank in the shard's own shuffle."""
    # the row travels as one value, so that no column of it meets the plan's own
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), "source", key(mix.seed).alias("__key"))
    rows = mix.assign(row).select("__doc", "__key", F.posexplode("__shards").alias("__copy", "__shard"))
    rows = rows.withColumn("__place", F.xxhash64(F.lit(mix.seed), "__key", "__copy"))
    dealt = rows.repartition(parts(docs.sparkSession), "__shard").sortWithinPartitions("__shard", "__place")
    return dealt.select("__doc.*", F.col("__shard").alias(shard), F.col("__place").alias(place))


def op7_mixture_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, shards.

    Null texts have size 0 and null sources are one source, last. Rows with equal id and text go together. An empty table gives no rows.
    """
    mix = plan(read(spark, sf_dir, "documents"))
    return mix.assign(mix.sized).select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.size("__shards")).alias("taken"), F.col("__shards").alias("shards"))

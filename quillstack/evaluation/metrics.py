"""Retrieval metrics in which an unjudged document is unknown, never irrelevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIG = ["need_id", "formulation", "architecture"]
KEYS = ["need_id", "doc_id"]


def judged(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """results with `relevant`: true, false or null where there is no judgment(need_id, doc_id, relevant)."""
    return results.join(judgments.select(*KEYS, "relevant"), KEYS, "left")


def precision_at(configs: DataFrame, results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """One row a configuration, also for empty results: the denominator is always k."""
    top = judged(results.where(F.col("rank") <= k), judgments)
    own = top.groupBy(*CONFIG).agg(F.count("doc_id").alias("returned"), F.count_if(F.col("relevant")).alias("n_relevant"), F.bool_and(F.col("relevant").isNotNull()).alias("all_judged"))
    out = configs.select(*CONFIG).join(own, CONFIG, "left").select(*CONFIG, F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.coalesce("all_judged", F.lit(True)).alias("all_judged"))
    return out.withColumn("missing_positions", F.lit(k) - F.col("returned")).withColumn("precision", F.round(F.col("n_relevant") / F.lit(float(k)), 4))


def precision_means(precision: DataFrame, by: list[str]) -> DataFrame:
    return precision.groupBy(*by).agg(F.round(F.avg("precision"), 4).alias("mean_precision"), F.count("*").alias("n_configs"))


def paired_difference(precision: DataFrame, a: str = "hybrid", b: str = "vector") -> DataFrame:
    """(need_id, formulation, a, b, difference) in one conditional aggregation."""
    of = lambda name: F.max(F.when(F.col("architecture") == name, F.col("precision")))
    return precision.groupBy("need_id", "formulation").agg(of(a).alias(a), of(b).alias(b)).withColumn("difference", F.round(F.col(a) - F.col(b), 4))


def relevant_coverage(configs: DataFrame, results: DataFrame, judgments: DataFrame, depth: int | None = None) -> DataFrame:
    """Of a need's known relevant documents, the share each configuration returned; null if none is known."""
    known = judgments.where("relevant").groupBy("need_id").agg(F.countDistinct("doc_id").alias("n_known"))
    rows = results if depth is None else results.where(F.col("rank") <= depth)
    hit = rows.join(judgments.where("relevant").select(*KEYS), KEYS, "left_semi").groupBy(*CONFIG).agg(F.countDistinct("doc_id").alias("n_found"))
    out = configs.select(*CONFIG).join(known, "need_id", "left").join(hit, CONFIG, "left").select(*CONFIG, F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("n_found", F.lit(0)).alias("n_found"))
    return out.withColumn("coverage", F.when(F.col("n_known") > 0, F.round(F.col("n_found") / F.col("n_known"), 4)))


def set_analysis(sets: DataFrame, judgments: DataFrame, n_corpus: int | None = None, share: float = 0.5) -> DataFrame:
    """Unranked sets: sizes, judged and unjudged members, and the judged share; no precision at a rank."""
    own = judged(sets, judgments).groupBy("need_id", "formulation").agg(F.count("*").alias("set_size"), F.count_if(F.col("relevant").isNotNull()).alias("n_judged"), F.count_if(F.col("relevant")).alias("n_relevant"), F.count_if(~F.col("relevant")).alias("n_irrelevant"))
    out = own.withColumn("n_unjudged", F.col("set_size") - F.col("n_judged")).withColumn("judged_share", F.round(F.col("n_judged") / F.col("set_size"), 4))
    return out if n_corpus is None else out.withColumn("is_broad", F.col("set_size") >= share * n_corpus)


def recall_under_pool(configs: DataFrame, results: DataFrame, judgments: DataFrame, ks: list[int]) -> DataFrame:
    """(config, k, recall): the share of the pool's relevant documents within the first k."""
    from functools import reduce

    parts = [relevant_coverage(configs, results, judgments, k).select(*CONFIG, F.lit(k).alias("k"), F.col("coverage").alias("recall")) for k in ks]
    return reduce(DataFrame.union, parts)


def rank_metrics(configs: DataFrame, results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(config, mrr, ap, ndcg) over the first k with binary gains; unjudged documents hold their rank and count for nothing either way."""
    known = judgments.where("relevant").groupBy("need_id").agg(F.countDistinct("doc_id").alias("n_known"))
    top = results.where(F.col("rank") <= k).join(judgments.where("relevant").select(*KEYS, F.lit(1).alias("hit")), KEYS, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy(*CONFIG).orderBy("rank"))
    own = top.withColumn("so_far", so_far).groupBy(*CONFIG).agg(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank"))).alias("ap"), F.sum(F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + 1))).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_known"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    out = configs.select(*CONFIG).join(own, CONFIG, "left").join(known, "need_id", "left")
    some = F.col("n_known") > 0
    return out.select(*CONFIG, F.round(F.when(some, F.coalesce("rr", F.lit(0.0))), 4).alias("mrr"), F.round(F.when(some, F.coalesce("ap", F.lit(0.0)) / F.least(F.col("n_known"), F.lit(k))), 4).alias("ap"), F.round(F.when(some, F.coalesce("dcg", F.lit(0.0)) / best), 4).alias("ndcg"))

"""Pools of candidates: union of rankings and small sets, strata, seeded samples, one row a need and document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.sampling import inclusion_probability, sample_size_col, sampled
from quillstack.functions.text import description_terms, fold_evaluation

KEYS = ["need_id", "doc_id"]


def _holds_any(field: str, terms: Column) -> Column:
    return F.exists(terms, lambda t: fold_evaluation(field).contains(t))


def condition_complement(corpus: DataFrame, conditions: list[dict]) -> DataFrame:
    """doc_id of the documents in which, for each metadata condition, each field holds any of its description's terms.

    A condition without terms matches nothing; without metadata conditions the set is empty. Null never matches.
    """
    tests: list[Column] = []
    for c in conditions:
        if c.get("relates_to") != "metadata" or not c.get("fields"):
            continue
        terms = description_terms(F.lit(c["description"]))
        tests += [_holds_any(f, terms) for f in c["fields"]]
    return corpus.where(reduce(lambda a, b: a & b, tests) if tests else F.lit(False)).select("doc_id")


def union_of(rankings: DataFrame, sets: DataFrame, complement: DataFrame, depth: int, most_set: int, most_complement: int) -> DataFrame:
    """J0 (need_id, doc_id): top `depth` of rankings(need_id, formulation, architecture, doc_id, rank), small structured sets(need_id,
    formulation, doc_id) and a small complement(need_id, doc_id)."""
    sizes = sets.groupBy("need_id", "formulation").agg(F.count("*").alias("n")).where(F.col("n") <= most_set).select("need_id", "formulation")
    small = complement.groupBy("need_id").agg(F.count("*").alias("n")).where(F.col("n") <= most_complement).select("need_id")
    parts = [rankings.where(F.col("rank") <= depth), sets.join(sizes, ["need_id", "formulation"], "left_semi"), complement.join(small, "need_id", "left_semi")]
    return reduce(DataFrame.union, [p.select(*KEYS) for p in parts]).distinct()


def strata(sets: DataFrame, j0: DataFrame, most_set: int) -> DataFrame:
    """(need_id, formulation, doc_id, stratum) of sets above the limit: I is in J0, R the rest. Never looks at what is judged later."""
    large = sets.groupBy("need_id", "formulation").agg(F.count("*").alias("n")).where(F.col("n") > most_set).select("need_id", "formulation")
    return sets.join(large, ["need_id", "formulation"], "left_semi").join(j0.withColumn("__in", F.lit(True)), KEYS, "left").select("need_id", "formulation", "doc_id", F.when(F.col("__in"), "I").otherwise("R").alias("stratum"))


#: The name under which a need's condition complement is split and sampled, beside its formulations.
CONDITIONS = "conditions"


def complement_sets(complement: DataFrame) -> DataFrame:
    """The complements (need_id, doc_id) as sets of their own, for strata and samples."""
    return complement.select("need_id", F.lit(CONDITIONS).alias("formulation"), "doc_id")


def all_strata(sets: DataFrame, complement: DataFrame, j0: DataFrame, most_set: int, most_complement: int) -> DataFrame:
    """strata of the structured sets and of the complements, each above its own limit."""
    return strata(sets, j0, most_set).union(strata(complement_sets(complement), j0, most_complement))


def stratum_sizes(split: DataFrame) -> DataFrame:
    """(need_id, formulation, n_i, n_r, s_r, p_r)"""
    n = split.groupBy("need_id", "formulation").agg(F.count_if(F.col("stratum") == "I").alias("n_i"), F.count_if(F.col("stratum") == "R").alias("n_r"))
    return n.withColumn("s_r", sample_size_col(F.col("n_r"))).withColumn("p_r", inclusion_probability(F.col("s_r"), F.col("n_r")))


def stratum_sample(split: DataFrame, seed: int | str) -> DataFrame:
    """(need_id, formulation, doc_id) drawn from R, independently for each formulation."""
    rest = split.where(F.col("stratum") == "R").join(stratum_sizes(split).select("need_id", "formulation", "s_r"), ["need_id", "formulation"])
    return sampled(rest, ["need_id", "formulation"], "doc_id", F.col("s_r"), seed).select("need_id", "formulation", "doc_id")


def pool(j0: DataFrame, sample: DataFrame) -> DataFrame:
    """All to judge: (need_id, doc_id, in_j0, in_sample)"""
    both = j0.select(*KEYS, F.lit(True).alias("a"), F.lit(False).alias("b")).union(sample.select(*KEYS, F.lit(False), F.lit(True)))
    return both.groupBy(*KEYS).agg(F.bool_or("a").alias("in_j0"), F.bool_or("b").alias("in_sample"))


def with_strata(candidates: DataFrame, split: DataFrame, complement: DataFrame) -> DataFrame:
    """candidates with `strata` (formulation, or "conditions", to stratum and inclusion probability) and in_condition_complement."""
    sizes = stratum_sizes(split).select("need_id", "formulation", "p_r")
    own = split.join(sizes, ["need_id", "formulation"]).withColumn("p", F.when(F.col("stratum") == "I", 1.0).otherwise(F.col("p_r")))
    maps = own.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("formulation", F.struct("stratum", F.col("p").alias("inclusion_probability")))))).alias("strata"))
    within = complement.select(*KEYS).distinct().withColumn("in_condition_complement", F.lit(True))
    out = candidates.join(maps, KEYS, "left").join(within, KEYS, "left")
    return out.withColumn("in_condition_complement", F.coalesce("in_condition_complement", F.lit(False)))


def with_recall(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """candidates with `by_formulation`: map of formulation to the architectures' ranks, in the order structured, vector, hybrid."""
    order = {"structured": 0, "vector": 1, "hybrid": 2}
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    own = rankings.groupBy(*KEYS, "formulation").agg(F.array_sort(F.collect_list(F.struct(place[F.col("architecture")].alias("turn"), "architecture", "rank"))).alias("recalled"))
    maps = own.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("formulation", "recalled"))).alias("by_formulation"))
    return candidates.join(maps, KEYS, "left")

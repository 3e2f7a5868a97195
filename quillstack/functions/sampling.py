"""Sample sizes with finite population correction, hash-order samples and the stratified estimator."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def base_size(z: float = 1.96, p: float = 0.5, error: float = 0.1) -> float:
    """z^2 p (1 - p) / e^2."""
    if not 0 < p < 1 or error <= 0:
        raise ValueError("p must lie in (0, 1) and the error be positive")
    return z * z * p * (1 - p) / (error * error)


def sample_size(n: int, n0: float | None = None) -> int:
    if n < 0:
        raise ValueError("a population can't be negative")
    n0 = base_size() if n0 is None else n0
    return 0 if n == 0 else min(n, math.ceil(n0 / (1 + (n0 - 1) / n)))


def sample_size_col(n: Column, n0: float | None = None) -> Column:
    n0 = base_size() if n0 is None else n0
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.least(n.cast("long"), F.ceil(F.lit(n0) / (F.lit(1.0) + F.lit(n0 - 1.0) / n)).cast("long")))


def derived_seed(seed: int | str, *parts: str) -> int:
    """The first eight bytes, big endian, of the SHA-256 of seed and parts."""
    return int.from_bytes(hashlib.sha256(SEPARATOR.join([str(seed), *parts]).encode()).digest()[:8], "big")


def sample_order(seed: int | str, *keys: Column | str) -> Column:
    """A seeded order: the SHA-256 of the seed and the keys."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(str(seed)), *keys), 256)


def seeded_rows(df: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """n rows of a seeded order, all of them if there are fewer."""
    return df.orderBy(sample_order(seed, F.col(key).cast("string")), key).limit(n)


def sampled(df: DataFrame, groups: list[str], key: str, size: Column, seed: int | str) -> DataFrame:
    """A simple random sample without replacement of `size` rows for each group, independent between groups."""
    order = Window.partitionBy(*groups).orderBy(sample_order(seed, *groups, F.col(key).cast("string")), key)
    return df.withColumn("__draw", F.row_number().over(order)).where(F.col("__draw") <= size).drop("__draw")


def inclusion_probability(drawn: Column, population: Column) -> Column:
    return F.when(population > 0, drawn / population).otherwise(0.0)


def stratified_estimate(n_i: Column, p_i: Column, n_r: Column, s_r: Column, p_r: Column, z: float = 1.96) -> dict[str, Column]:
    """Proportion, variance and interval when stratum I is a census and R a sample of s_r of n_r."""
    n = n_i + n_r
    p = F.when(n > 0, (n_i * p_i + n_r * p_r) / n).otherwise(0.0)
    own = F.when((s_r > 0) & (n_r > 1), p_r * (1 - p_r) / s_r * (n_r - s_r) / (n_r - 1)).otherwise(0.0)
    variance = F.when(n > 0, F.pow(n_r / n, 2) * own).otherwise(0.0)
    return {"p_hat": p, "variance": variance, "low": F.greatest(F.lit(0.0), p - z * F.sqrt(variance)), "high": F.least(F.lit(1.0), p + z * F.sqrt(variance))}


def stratified_wilson(n_i: Column, p_i: Column, n_r: Column, s_r: Column, p_r: Column, z: float = 1.96) -> dict[str, Column]:
    """The interval of the stratified share for samples that are small or near 0 or 1: stratum I as it is, R by its Wilson bounds; a whole R has none."""
    n, whole = n_i + n_r, s_r >= n_r
    low, high = (F.when(whole | (n_r <= 0), p_r).otherwise(F.coalesce(x, F.lit(end))) for x, end in zip(wilson(p_r, s_r, z), (0.0, 1.0), strict=True))
    return {name: F.when(n > 0, (n_i * p_i + n_r * x) / n).otherwise(0.0) for name, x in (("wilson_low", low), ("wilson_high", high))}


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval, for shares near 0 or 1; null without a sample."""
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)

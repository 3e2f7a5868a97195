"""Vector functions over array<float>: dot products, normalisation and a hashed bag-of-words encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Summed in double, left to right, so results don't depend on the plan."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str) -> Column:
    """A vector of length one; a zero vector stays. The length is bound once, not for each element."""
    a = F.col(a) if isinstance(a, str) else a
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))[0]


def word_slots(words: Column | str, dim: int = 64) -> Column:
    """Each word's slot: the first 16 bits of its md5 modulo dim."""
    words = F.col(words) if isinstance(words, str) else words
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)


def hashed_bag(words: Column | str, dim: int = 64) -> Column:
    """Counts of words by slot, of length one. Slots come from Spark's md5; only counting, which no function does in one pass, is an Arrow UDF."""

    @F.pandas_udf("array<double>")
    def counted(slots: pd.Series) -> pd.Series:
        bags = [np.bincount(np.asarray(s, dtype=np.int64), minlength=dim).astype(float) if len(s) else np.zeros(dim) for s in slots]
        return pd.Series([b / (np.linalg.norm(b) or 1.0) for b in bags])

    return counted(word_slots(words, dim))


def encoder(model: Callable[[list[str]], "list[list[float]]"]) -> Callable[[Column], Column]:
    """An Arrow UDF around any batch encoder, for models that Spark functions can't express."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model(texts.fillna("").tolist())))

    return encode

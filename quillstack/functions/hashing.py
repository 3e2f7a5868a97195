"""File hashes, document ids and an order-independent fingerprint of a table."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8 * 1024 * 1024
#: Hex digits of a lane of table_hash, so that a lane is a 64-bit integer.
LANE = 15


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def document_id(key: Column | str, prefix: str = "doc-") -> Column:
    """The prefix and 12 hex digits of the key's SHA-256."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), F.substring(F.sha2(key.cast("string"), 256), 1, 12))


def canonical(name: str, kind: str) -> Column:
    """A value's tagged text: null, booleans, numbers, times and strings never collide."""
    c = F.col(f"`{name}`")
    if kind == "boolean":
        text = F.concat(F.lit("b:"), F.when(c, "true").otherwise("false"))
    elif kind in ("double", "float"):
        # infinities keep their sign, zero loses it
        text = F.concat(F.lit("f:"), F.when(F.isnan(c), "NaN").when(c == 0, "0.0").otherwise(c.cast("double").cast("string")))
    elif kind.startswith(("timestamp", "date")):
        text = F.concat(F.lit("t:"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        text = F.concat(F.lit("i:"), c.cast("string"))
    elif kind == "string":
        text = F.concat(F.lit("s:"), c)
    else:
        text = F.concat(F.lit("j:"), F.to_json(F.struct(c.alias("v"))))
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def row_hash(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\u001f", *(canonical(c, kinds[c]) for c in sorted(df.columns))), 256)


def table_hash(hashes: DataFrame, row: str = "h") -> DataFrame:
    """One row (fingerprint) of a table of SHA-256 row hashes, the same in every order; repeated rows count.

    The hashes' four lanes of 60 bits are summed exactly and the sums are hashed with the number of rows: each task sends
    one row, so no list of hashes is ever made.
    """
    lanes = [F.conv(F.substring(row, 1 + LANE * k, LANE), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = hashes.agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{k}") for k, x in enumerate(lanes)))
    told = [F.col("n").cast("string"), *(F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in range(4))]
    return sums.select(F.sha2(F.concat_ws(":", *told), 256).alias("fingerprint"))


def fingerprint(df: DataFrame) -> str:
    """Of schema and rows; independent of row order, files and partitions."""
    schema = json.dumps(sorted(df.dtypes))
    rows = table_hash(df.select(row_hash(df).alias("h"))).first()["fingerprint"]
    return hashlib.sha256(f"{schema}\n{rows}".encode()).hexdigest()

"""Metadata profiles: nulls, blanks, formatting signs, raw and folded distinct values, top and rare values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.hashing import fingerprint
from quillstack.functions.text import fold_diagnostic, is_blank, strip
from quillstack.sources.publish import markdown_table

TOP, RARE_SHOWN, RARE_MOST = 15, 20, 1


def field_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row a field: counts over one pass of the rows.

    Rows are summed by 128 bits of hash of the value in the tasks first; what is shuffled is a few counts for each different value.
    """
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields)))
    x = df.select(values.alias("x")).select("x.*")
    v, bare = F.col("v"), strip("v")
    there = ~is_blank(v)
    flags = {
        "n_null": v.isNull(),
        "n_empty": v.isNotNull() & is_blank(v),
        "n_present": there,
        "n_edge_space": v.isNotNull() & (v != bare),
        "n_trailing_dot": there & bare.endswith("."),
        "n_multivalue": there & bare.contains(";"),
    }
    known = x.select("field", F.unhex(F.md5(v)).alias("value"), F.when(there, F.unhex(F.md5(fold_diagnostic(v)))).alias("folded"), *(c.alias(n) for n, c in flags.items()))
    by_value = known.groupBy("field", "value", "folded", "n_present").agg(F.count("*").alias("n_total"), *(F.count_if(n).alias(f"k_{n}") for n in flags))
    by_folded = by_value.groupBy("field", "folded").agg(F.sum("n_total").alias("n_total"), *(F.sum(f"k_{n}").alias(n) for n in flags), F.count_if("n_present").alias("raw"))
    return by_folded.groupBy("field").agg(F.sum("n_total").alias("n_total"), *(F.sum(n).alias(n) for n in flags), F.sum("raw").alias("n_distinct_raw"), F.count("folded").alias("n_distinct_folded"))


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """(value, n) of values that are there, as they are."""
    return df.where(~is_blank(field)).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, field: str, limit: int = TOP) -> DataFrame:
    """The commonest values; of equal counts the least value first."""
    return value_counts(df, field).orderBy(F.desc("n"), "value").limit(limit)


def rare_values(df: DataFrame, field: str, most: int = RARE_MOST, limit: int = RARE_SHOWN) -> DataFrame:
    """The first values that occur at most `most` times, and how many there are."""
    rare = value_counts(df, field).where(F.col("n") <= most)
    total = rare.agg(F.count("*").alias("n_rare"))
    return rare.orderBy("value").limit(limit).crossJoin(F.broadcast(total))  # one row beside the shown ones


def fingerprint_status(df: DataFrame, recorded: str | None) -> bool | None:
    """Whether the table is the recorded one; None if nothing was recorded."""
    return None if recorded is None else fingerprint(df) == recorded


def profile_report(df: DataFrame, fields: list[str], recorded: str | None = None) -> str:
    """Markdown, the same for the same rows."""
    rows = sorted(field_profile(df, fields).collect(), key=lambda r: fields.index(r["field"]))  # a row for each field
    names = list(rows[0].asDict()) if rows else []
    out = ["# Metadata profile", "", f"fingerprint matches: {fingerprint_status(df, recorded)}", "", markdown_table(names, [tuple(r) for r in rows])]
    for f in fields:
        out += ["", f"## {f}", "", markdown_table(["value", "n"], [tuple(r) for r in top_values(df, f).collect()])]
        rare = rare_values(df, f).collect()
        out += ["", f"rare values: {rare[0]['n_rare'] if rare else 0}", ""] + [f"- {r['value']}" for r in rare]
    return "\n".join(out) + "\n"

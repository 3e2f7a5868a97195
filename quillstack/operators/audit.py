"""Quality audit: coverage, distinct values, duplicate keys, text lengths, missing texts, and its reports."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.sampling import seeded_rows
from quillstack.functions.text import is_blank
from quillstack.sources.config import CorpusConfig
from quillstack.sources.manifest import Manifest
from quillstack.sources.publish import markdown_table, together, write_json


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_total, n_missing, coverage_pct, n_distinct) in one pass; blanks are missing but count as values.

    Values are counted by 128 bits of hash, summed in the tasks first, so no text is shuffled.
    """
    columns = columns or df.columns
    own = [F.col(f"`{c}`").cast("string") for c in columns]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.unhex(F.md5(c)).alias("value"), is_blank(c).alias("blank")) for i, c in enumerate(own)))
    by_value = df.select(F.explode(cells).alias("x")).groupBy("x.i", "x.value").agg(F.count("*").alias("n"), F.count_if("x.blank").alias("m"))
    told = by_value.groupBy("i").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("value").alias("d"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column_name string")
    zero = F.lit(0).cast("long")
    rows = names.join(told, "i", "left").select("column_name", F.coalesce("n", zero).alias("n_total"), F.coalesce("m", zero).alias("n_missing"), F.coalesce("d", zero).alias("n_distinct"))
    share = F.when(F.col("n_total") == 0, 0.0).otherwise(F.round(100.0 * (F.col("n_total") - F.col("n_missing")) / F.col("n_total"), 2))
    return rows.select("column_name", "n_total", "n_missing", share.alias("coverage_pct"), "n_distinct")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_duplicates): non-null rows beyond the first of each key; blank strings are keys."""
    k = F.col(key)
    return df.agg(F.count(k).alias("n_rows"), F.countDistinct(k).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def text_lengths(df: DataFrame, text: str, groups: list[str] | None = None) -> DataFrame:
    """Count, min, max, mean, median, quartiles of lengths in characters; nulls are left out, blanks are not."""
    n = F.length(F.col(text))
    exact = lambda q: F.round(F.percentile(n, q), 2)
    return df.groupBy(*(groups or [])).agg(F.count(n).alias("n_texts"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.round(F.avg(n), 2).alias("mean_len"), exact(0.5).alias("median_len"), exact(0.25).alias("p25_len"), exact(0.75).alias("p75_len"))


def without_text(df: DataFrame, text: str, index: str) -> DataFrame:
    """(row_index) of the rows whose text is missing."""
    return df.where(is_blank(text)).select(F.col(index).alias("row_index"))


def conditional(df: DataFrame, field: str | None, run) -> dict:
    """A result that tells a metric of nought from one that was not computed."""
    if field is None:
        return {"status": "not_configured", "result": None}
    if field not in df.columns:
        return {"status": "field_missing", "result": None}
    return {"status": "ok", "result": run(field)}


def audit(df: DataFrame, config: CorpusConfig) -> dict:
    """The whole audit of a raw table with a row_index column."""
    data = [c for c in df.columns if c != "row_index"]
    one = lambda frame: frame.first().asDict()
    profile = [r.asDict() for r in column_profile(df, data).collect()]  # a row for each column
    return {
        "n_rows": df.count(),
        "columns": profile,
        "missing_columns": [c for c in config.allowed_fields if c not in data],
        "duplicates": conditional(df, config.primary_key_field, lambda f: one(duplicate_keys(df, f))),
        "lengths": conditional(df, config.text_field, lambda f: one(text_lengths(df, f))),
        "without_text": conditional(df, config.text_field, lambda f: {"n": without_text(df, f, "row_index").count()} if "row_index" in df.columns else {"n": df.where(is_blank(f)).count()}),
        "metadata": [p for p in profile if p["column_name"] in (config.metadata_fields or [])],
    }


def run_audit(df: DataFrame, config: CorpusConfig, manifest: Manifest, file: str | Path) -> dict:
    """Gates in order: no pending entries, the file exists, its provenance holds."""
    manifest.gate()
    if not Path(file).exists():
        raise FileNotFoundError(file)
    manifest.validate(file)
    return audit(df, config)


def write_csv(path: Path, columns: list[str], rows: list[tuple]) -> None:
    with path.open("w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([columns, *rows])


def save_reports(result: dict, sample: DataFrame, folder: str | Path, key: str) -> list[Path]:
    """Seven files, always all: summary, duplicates, lengths, column and length tables, sample, report. Where one of them is there
    already, all get the same time in their names, so that no report replaces another."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    files = together(folder, ["summary.json", "duplicates.json", "lengths.json", "columns.csv", "lengths.csv", "sample.md", "report.md"])
    write_json(files["summary.json"], {k: result[k] for k in ("n_rows", "columns", "missing_columns", "metadata")})
    write_json(files["duplicates.json"], result["duplicates"])
    write_json(files["lengths.json"], {"lengths": result["lengths"], "without_text": result["without_text"]})
    names = ["column_name", "n_total", "n_missing", "coverage_pct", "n_distinct"]
    write_csv(files["columns.csv"], names, [tuple(c[n] for n in names) for c in result["columns"]])
    lengths = result["lengths"]["result"] or {}
    write_csv(files["lengths.csv"], ["measure", "value"], [("status", result["lengths"]["status"]), *lengths.items()])
    rows = [tuple(r) for r in seeded_rows(sample, key).collect()]
    files["sample.md"].write_text(markdown_table(sample.columns, rows), "utf-8")
    body = [f"# Audit\n\nRows: {result['n_rows']}\n", markdown_table(["column", "missing", "coverage %", "distinct"], [(c["column_name"], c["n_missing"], c["coverage_pct"], c["n_distinct"]) for c in result["columns"]])]
    for part in ("duplicates", "lengths", "without_text"):
        lines = [f"- {a}: {b}" for a, b in (result[part]["result"] or {}).items()]
        body.append("\n".join([f"\n## {part}\n\nstatus: {result[part]['status']}\n", *lines]))
    files["report.md"].write_text("\n".join(body), "utf-8")
    return sorted(files.values())


def predicate_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Row counts for every combination of flags, with cube totals (null: any)."""
    flags = df.select(*(p.alias(n) for n, p in predicates.items()))
    return flags.cube(*predicates).agg(F.count("*").alias("n"))

"""Canonicalisation: key and required-field rejects, first-of-key, ids, role-ordered columns, published with its account."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.hashing import document_id, fingerprint
from quillstack.functions.text import is_blank
from quillstack.sources.config import CorpusConfig
from quillstack.sources.manifest import Manifest
from quillstack.sources.publish import publish


class CollisionError(RuntimeError):
    """Different keys share a document id."""


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; one that the data lacks is all null."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def reject_reason(df: DataFrame, key: str, required: list[str]) -> Column:
    """The first reason that holds, or null: a blank key, then each required field in order (one that the data lacks is missing)."""
    reason = F.when(is_blank(key), "source_key_null_or_empty")
    for c in required:
        missing = is_blank(c) if c in df.columns else F.lit(True)
        reason = reason.when(missing, f"required_field_missing:{c}")
    return reason


def split_rejects(df: DataFrame, key: str, required: list[str], order: str) -> DataFrame:
    """df with `reason`. Repeats of a key lose to the first accepted row; rows rejected for a field claim no key."""
    own = df.withColumn("reason", reject_reason(df, key, required))
    turn = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(order))
    return own.withColumn("__turn", turn).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__turn") > 1), "duplicate_source_key").otherwise(F.col("reason"))).drop("__turn")


def collisions(df: DataFrame, doc_id: str, key: str) -> DataFrame:
    """(doc_id, n_keys) of ids with several keys."""
    return df.groupBy(F.col(doc_id).alias("doc_id")).agg(F.countDistinct(key).alias("n_keys")).where("n_keys > 1")


@dataclass
class Canonical:
    accepted: DataFrame
    rejected: DataFrame


def canonicalise(df: DataFrame, config: CorpusConfig, order: str = "row_index") -> Canonical:
    """doc_id, source_key and the role-ordered columns of accepted rows; (source_key, row_index, reason) of the others."""
    key = config.primary_key_field
    if key is None:
        raise ValueError("a primary_key_field is needed")
    split = split_rejects(df, key, config.required_fields or [], order)
    kept = split.where(F.col("reason").isNull()).withColumn("doc_id", document_id(key, config.doc_id_prefix)).withColumn("source_key", F.col(key))
    shown_key = F.when(F.col("reason") == "source_key_null_or_empty", F.lit(None)).otherwise(F.col(key))
    lost = split.where(F.col("reason").isNotNull()).select(shown_key.alias("source_key"), F.col(order).alias("row_index"), "reason")
    return Canonical(project(kept, ["doc_id", "source_key", *config.canonical_columns()]), lost)


def run_canonical(df: DataFrame, config: CorpusConfig, manifest: Manifest, file: str | Path, folder: str | Path, fingerprint_log: str | Path | None = None) -> dict[str, Path | str]:
    """Provenance, then the pending gate; ids must not collide and all rows be accounted for; then published with a sidecar.

    The log of fingerprints is a local file, beside the tables unless it is named.
    """
    entry = manifest.validate(file)
    manifest.gate()
    out = canonicalise(df, config)
    if found := collisions(out.accepted, "doc_id", "source_key").limit(5).collect():
        raise CollisionError(f"ids with several keys: {[r['doc_id'] for r in found]}")
    n, n_in, n_out = df.count(), out.accepted.count(), out.rejected.count()
    if n_in + n_out != n:
        raise ValueError(f"{n_in} accepted and {n_out} rejected rows of {n}")
    side = {"n_total": n, "n_accepted": n_in, "n_rejected": n_out, "dataset_fingerprint": fingerprint(out.accepted), "source_sha256": entry["sha256"], "excluded_fields": [c for c in df.columns if c not in config.allowed_fields], "field_roles": roles(config)}

    def check(name: str, back: DataFrame) -> None:
        if back.count() != {"canonical.parquet": n_in, "rejected.parquet": n_out}[name]:
            raise ValueError(f"{name} reads back with other rows")

    made = publish(df.sparkSession, folder, {"canonical.parquet": out.accepted, "rejected.parquet": out.rejected}, {"canonical.json": side}, check)
    log_fingerprint(Path(fingerprint_log or Path(folder) / "fingerprint_log.jsonl"), made["canonical.parquet"], config, side)
    return made


def log_fingerprint(log: Path, table: Path, config: CorpusConfig, side: dict) -> None:
    """One more line in the history of published tables. A failure is only told: the table is published, and its sidecar has the fingerprint."""
    line = {"at": datetime.now(UTC).isoformat(), "table": str(table), "schema_version": config.schema_version, "batch_id": config.batch_id} | {k: side[k] for k in ("dataset_fingerprint", "n_accepted", "n_rejected")}
    try:
        with log.open("a", encoding="utf-8") as f:
            f.write(json.dumps(line, ensure_ascii=False) + "\n")
    except OSError as e:
        warnings.warn(f"{log} has no line for {table}: {e}", stacklevel=2)


def roles(config: CorpusConfig) -> dict[str, list[str]]:
    """Each canonical field's roles."""
    out: dict[str, list[str]] = {}
    for role in ("retrieval_text_fields", "metadata_fields", "preserved_fields"):
        for c in getattr(config, role) or []:
            out.setdefault(c, []).append(role.removesuffix("_fields"))
    return out

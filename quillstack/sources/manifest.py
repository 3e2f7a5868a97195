"""Provenance manifests: append-only JSON lines, lookups, the pending gate and file validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillstack.functions.hashing import file_sha256

#: Fields of an entry that must be told (fixed values).
REQUIRED = ("original_filename", "stored_filename", "downloaded_at", "ingested_at", "file_size_bytes", "sha256", "dataset", "dataset_year", "schema_version", "batch_id")
KINDS = {"file_size_bytes": LongType(), "dataset_year": IntegerType()}
SCHEMA = StructType([StructField(c, KINDS.get(c, StringType())) for c in (*REQUIRED[:6], "source_url", "source_identifier", *REQUIRED[6:])])


class PendingManifestError(RuntimeError):
    """Unresolved entries stand in the pending queue."""


class ProvenanceError(RuntimeError):
    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass
class Manifest:
    """A manifest and its pending queue as JSON lines files."""

    path: Path
    pending_path: Path = field(default=None)

    def __post_init__(self) -> None:
        self.path = Path(self.path)
        self.pending_path = Path(self.pending_path or self.path.with_name("pending.jsonl"))

    def entries(self, path: Path | None = None) -> list[dict]:
        path = path or self.path
        return [json.loads(line) for line in path.read_text("utf-8").splitlines() if line.strip()] if path.exists() else []

    def frame(self, spark: SparkSession) -> DataFrame:
        """The manifest as a DataFrame; empty if there is none yet."""
        return spark.read.schema(SCHEMA).json(str(self.path)) if self.path.exists() else spark.createDataFrame([], SCHEMA)

    def append(self, entry: dict) -> None:
        """Adds a complete entry; one of source_url and source_identifier must be told."""
        missing = [c for c in REQUIRED if entry.get(c) in (None, "")]
        if missing:
            raise ValueError(f"missing fields: {missing}")
        if not (entry.get("source_url") or entry.get("source_identifier")):
            raise ValueError("a source_url or a source_identifier is needed")
        self._add(self.path, entry)

    def postpone(self, entry: dict) -> None:
        self._add(self.pending_path, entry)

    @staticmethod
    def _add(path: Path, entry: dict) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(entry, ensure_ascii=False, sort_keys=True) + "\n")

    def has_pending(self) -> bool:
        return bool(self.entries(self.pending_path))

    def gate(self) -> None:
        if self.has_pending():
            raise PendingManifestError(f"{self.pending_path} holds unresolved entries")

    def find(self, **by: str) -> dict | None:
        """The first entry with these values."""
        return next((e for e in self.entries() if all(e.get(k) == v for k, v in by.items())), None)

    def validate(self, file: str | Path) -> dict:
        """The file's entry, if the manifest has one and the content still matches."""
        file = Path(file)
        entry = self.find(stored_filename=file.name)
        if entry is None:
            raise ProvenanceError("provenance_missing")
        if not file.exists():
            raise ProvenanceError("file_not_found")
        if file_sha256(file) != entry["sha256"]:
            raise ProvenanceError("integrity_mismatch")
        return entry


def first_match(wanted: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """wanted with the first entry, by `order`, of equal key; null columns where there is none."""
    first = entries.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__turn = 1").drop("__turn")
    return wanted.join(first, key, "left")

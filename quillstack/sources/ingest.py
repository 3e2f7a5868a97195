"""Controlled ingestion of a file: gate, hash, duplicates, name conflicts, staging, promotion, manifest."""

from __future__ import annotations

import shutil
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from quillstack.functions.hashing import file_sha256
from quillstack.sources.manifest import Manifest

#: Lengths of the hash suffix tried for a free name (fixed values).
SUFFIX_DIGITS = (8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
#: Outcomes of an ingestion (fixed values).
STATUSES = ("ingested", "duplicate_content", "name_conflict_versioned", "integrity_error", "validation_error", "file_exists_consistent", "inconsistency_orphan_file", "manifest_pending", "blocked_pending_manifest")


@dataclass
class Ingested:
    status: str
    stored_filename: str | None = None
    sha256: str | None = None
    message: str = ""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Ingestor:
    """Copies files into raw_dir, each content once, never over another file."""

    raw_dir: Path
    manifest: Manifest
    describe: dict

    def __post_init__(self) -> None:
        self.raw_dir = Path(self.raw_dir)

    def ingest(self, source: str | Path, downloaded_at: str | None = None) -> Ingested:
        source = Path(source)
        if self.manifest.has_pending():
            return Ingested("blocked_pending_manifest", message="resolve the pending entries first")
        if not source.is_file():
            return Ingested("validation_error", message=f"{source} is no readable file")
        try:
            digest = file_sha256(source)
        except OSError as e:
            return Ingested("validation_error", message=str(e))
        if known := self.manifest.find(sha256=digest):
            there = (self.raw_dir / known["stored_filename"]).exists()
            return Ingested("duplicate_content", known["stored_filename"], digest, "content known" if there else "content known, its file is missing")
        name, status = source.name, "ingested"
        if (self.raw_dir / name).exists() and not self.manifest.find(stored_filename=name):
            return Ingested("inconsistency_orphan_file", name, digest, "a file without a manifest entry has this name")
        if self.manifest.find(original_filename=name) or self.manifest.find(stored_filename=name):
            name, status = self._free_name(source, digest), "name_conflict_versioned"
        staging = self.raw_dir / ".staging"
        staging.mkdir(parents=True, exist_ok=True)
        copy = staging / f"{digest}.part"
        try:
            shutil.copyfile(source, copy)
            if file_sha256(copy) != digest:
                return Ingested("integrity_error", None, digest, "the copy differs from the source")
            target = self.raw_dir / name
            if target.exists():  # promotion never overwrites
                known = self.manifest.find(stored_filename=name, sha256=file_sha256(target))
                return Ingested("file_exists_consistent" if known else "inconsistency_orphan_file", name, digest, "the name was taken meanwhile")
            copy.rename(target)
        finally:
            copy.unlink(missing_ok=True)
        entry = self.describe | {"original_filename": source.name, "stored_filename": name, "downloaded_at": downloaded_at or now(), "ingested_at": now(), "file_size_bytes": source.stat().st_size, "sha256": digest}
        try:
            self.manifest.append(entry)
        except OSError as e:
            self.manifest.postpone(entry)
            return Ingested("manifest_pending", name, digest, str(e))
        return Ingested(status, name, digest, "")

    def _free_name(self, source: Path, digest: str) -> str:
        taken = {e.get("stored_filename") for e in self.manifest.entries()}
        for n in SUFFIX_DIGITS:
            name = f"{source.stem}_{digest[:n]}{source.suffix}"
            if name not in taken and not (self.raw_dir / name).exists():
                return name
        raise ValueError(f"no free name for {source.name}")

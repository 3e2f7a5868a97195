"""Sinks: staged publication with read-back, names that never overwrite, latest artefacts, JSON sidecars, Markdown."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillstack.sources.storage import Folder


def stamped(path: Path, form: str = "%Y%m%d_%H%M%S") -> Path:
    """The path, or with the UTC time in its name if it is taken."""
    return path if not path.exists() else path.with_name(f"{path.stem}_{datetime.now(UTC).strftime(form)}{path.suffix}")


def together(folder: Path, names: list[str]) -> dict[str, Path]:
    """Paths for files of one set by their plain names: as they are, or all with the same time if one of them is taken."""
    paths = {n: folder / n for n in names}
    if not any(p.exists() for p in paths.values()):
        return paths
    when, turn = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), 0
    while any(p.exists() for p in paths.values()):
        mark = f"{when}_{turn}" if turn else when
        paths, turn = {n: folder / f"{Path(n).stem}_{mark}{Path(n).suffix}" for n in names}, turn + 1
    return paths


def write_json(path: str | Path, value: object) -> None:
    """Whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f.name, path)


def read_json(path: str | Path, key: str | None = None) -> object:
    path = Path(path)
    if not path.exists():
        return None
    value = json.loads(path.read_text("utf-8"))
    return value if key is None else value.get(key)


def latest(folder: str | Path, pattern: str) -> Path | None:
    """The last match by name; times in names make that the newest."""
    return max(Path(folder).glob(pattern), default=None, key=lambda p: p.name)


def publish(spark: SparkSession, folder: str | Path, frames: dict[str, DataFrame], sidecars: dict[str, object] | None = None, check: Callable[[str, DataFrame], None] | None = None) -> dict[str, Path | str]:
    """Writes all to a staging folder, reads the tables back, then moves everything; on any error nothing is published.

    The folder may be anywhere Spark's writers reach. Names that are taken get the time.
    """
    own, staging = Folder(spark, folder), f".staging-{uuid.uuid4().hex}"
    own.make()
    try:
        for name, df in frames.items():
            df.write.parquet(own.at(f"{staging}/{name}"))
            back = spark.read.parquet(own.at(f"{staging}/{name}"))
            if back.columns != df.columns:
                raise ValueError(f"{name} reads back with other columns")
            if check:
                check(name, back)
        held = Folder(spark, own.at(staging))
        held.make()
        for name, value in (sidecars or {}).items():
            held.write_json(name, value)
        out = {}
        for name in [*frames, *(sidecars or {})]:
            place = own.free(name)
            own.rename(f"{staging}/{name}", place)
            out[name] = own.located(place)
        return out
    finally:
        own.delete(staging)


def markdown_table(columns: list[str], rows: list[tuple], limit: int = 100) -> str:
    """Pipes escaped, long values cut."""

    def cell(v: object) -> str:
        text = "" if v is None else str(v)
        return (text[:limit] + "…" if len(text) > limit else text).replace("|", "\\|").replace("\n", " ")

    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])

"""Folders wherever Spark's tables can be: a local disk, HDFS or an object store, through Hadoop's file systems."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime
from fnmatch import fnmatch
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession


class Folder:
    """One folder by its path or URL; names below it may have slashes."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.base = str(path).rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, name: str) -> str:
        return f"{self.base}/{name}"

    def located(self, name: str) -> Path | str:
        """Where a name is: a Path on a local disk, else a URL."""
        return self.at(name) if re.match(r"\w+:", self.base) else Path(self.base) / name

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.base)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def make(self) -> None:
        fs, path = self._path("")
        fs.mkdirs(path)

    def delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def rename(self, old: str, new: str) -> None:
        fs, path = self._path(old)
        if not fs.rename(path, self._path(new)[1]):
            raise OSError(f"{self.at(old)} can't become {new}")

    def names(self, pattern: str = "*") -> list[str]:
        """Names in the folder itself that match, in order."""
        fs, path = self._path("")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if fnmatch(n, pattern))

    def free(self, name: str, form: str = "%Y%m%d_%H%M%S") -> str:
        """The name, or with the UTC time in it if it is taken, and a number if that is too."""
        pure, turn, out = PurePosixPath(name), 0, name
        while self.exists(out):
            mark = datetime.now(UTC).strftime(form) + (f"_{turn}" if turn else "")
            out, turn = f"{pure.stem}_{mark}{pure.suffix}", turn + 1
        return out

    def write_text(self, name: str, text: str) -> None:
        """Whole or not at all: beside its place first, then renamed."""
        fresh = f".{uuid.uuid4().hex}"
        fs, path = self._path(fresh)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(name)
        self.rename(fresh, name)

    def read_text(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_json(self, name: str, value: object) -> None:
        self.write_text(name, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))

    def read_json(self, name: str) -> object:
        text = self.read_text(name)
        return None if text is None else json.loads(text)

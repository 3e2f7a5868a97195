"""What every retriever returns: ranked documents and one row of diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame


@dataclass
class Retrieval:
    """documents: doc_id, rank, score (null where a set has no relevance), evidence."""

    query: str
    architecture: str
    documents: DataFrame
    fields_used: list[str] = field(default_factory=list)
    diagnostics: dict = field(default_factory=dict)


class Retriever(Protocol):
    def retrieve(self, query: str) -> Retrieval: ...

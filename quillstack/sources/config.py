"""Corpus configuration: roles of columns, eligibility policy, YAML or TOML files; checked before any I/O."""

from __future__ import annotations

import tomllib
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, Field, model_validator


class Placeholder(BaseModel):
    """Texts that stand for a withheld one."""

    field: str
    match: Literal["prefix", "exact"] = "prefix"
    patterns: list[str] = Field(default_factory=list)


class Eligibility(BaseModel):
    version: str = "1.0"
    required_text_fields: list[str] = Field(default_factory=list)
    forbidden_exact_values: dict[str, list[str]] = Field(default_factory=dict)
    placeholder: Placeholder | None = None

    def fields(self) -> set[str]:
        return {*self.required_text_fields, *self.forbidden_exact_values, *([self.placeholder.field] if self.placeholder else [])}


class CorpusConfig(BaseModel):
    """Every role names allowed fields only."""

    allowed_fields: list[str]
    primary_key_field: str | None = None
    text_field: str | None = None
    required_fields: list[str] | None = None
    metadata_fields: list[str] | None = None
    retrieval_text_fields: list[str] | None = None
    preserved_fields: list[str] | None = None
    eligibility: Eligibility | None = None
    dataset: str = ""
    dataset_year: int | None = None
    schema_version: str = "1.0"
    batch_id: str = ""
    doc_id_prefix: str = "doc-"

    @model_validator(mode="after")
    def _roles(self) -> CorpusConfig:
        roles = {r: getattr(self, r) or [] for r in ("required_fields", "metadata_fields", "retrieval_text_fields", "preserved_fields")}
        roles |= {r: [v] for r in ("primary_key_field", "text_field") if (v := getattr(self, r))}
        roles["eligibility"] = sorted(self.eligibility.fields()) if self.eligibility else []
        for role, names in roles.items():
            if outside := [n for n in names if n not in self.allowed_fields]:
                raise ValueError(f"{role} names fields outside allowed_fields: {outside}")
        return self

    def canonical_columns(self) -> list[str]:
        """Retrieval text, metadata, preserved: each field once, where it comes first."""
        return list(dict.fromkeys([*(self.retrieval_text_fields or []), *(self.metadata_fields or []), *(self.preserved_fields or [])]))


def load_config(path: str | Path) -> CorpusConfig:
    """From .yaml, .yml or .toml."""
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        try:
            value = yaml.safe_load(path.read_text("utf-8"))
        except (OSError, yaml.YAMLError) as e:
            raise ValueError(f"{path}: {e}") from e
    elif path.suffix == ".toml":
        try:
            value = tomllib.loads(path.read_text("utf-8"))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ValueError(f"{path}: {e}") from e
    else:
        raise ValueError(f"unknown kind of configuration: {path.suffix}")
    if not isinstance(value, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return CorpusConfig(**value)

"""Information needs: sheets with three formulations, their checks and their table."""

from __future__ import annotations

import re
from enum import StrEnum
from pathlib import Path

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationInfo, field_validator, model_validator
from pyspark.sql import DataFrame, SparkSession

FORMULATIONS = ("direct", "paraphrase", "verbose")
#: Metadata fields a condition may name, unless the sheets' reader is given others (fixed values).
METADATA_FIELDS = ("COLEGIADO", "RELATOR", "TIPOPROCESSO", "DATASESSAO", "ENTIDADE", "UNIDADETECNICA")
NEED_ID, FINGERPRINT = re.compile(r"NI-[0-9]{3}"), re.compile(r"[0-9a-f]{64}")


class Nature(StrEnum):
    METADATA = "metadata"
    TEXTUAL = "textual"
    MIXED = "mixed"


class Basis(StrEnum):
    """What a condition is about."""

    METADATA = "metadata"
    TEXTUAL = "textual"


class Cardinality(StrEnum):
    SINGLE = "single"
    ENUMERATION = "enumeration"
    MULTIDOCUMENT = "multidocument"


#: Answers that several documents make up together.
SEVERAL = (Cardinality.ENUMERATION, Cardinality.MULTIDOCUMENT)
#: Parts that a sheet must have by its status.
REQUIRED_PARTS = {"draft": (), "validated": (*FORMULATIONS, "requested_facts", "rationale", "reviewers")}


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Scope(_Strict):
    corpus: str
    temporal: str
    selection_fingerprint: str

    @field_validator("selection_fingerprint")
    @classmethod
    def _hex(cls, v: str) -> str:
        if not FINGERPRINT.fullmatch(v):
            raise ValueError("selection_fingerprint must be 64 lower-case hex digits")
        return v


class Condition(_Strict):
    """Only a condition about metadata may name fields, and only known ones: those in the validation's context, or METADATA_FIELDS."""

    description: str
    relates_to: Basis
    fields: list[str] = Field(default_factory=list)

    @field_validator("fields")
    @classmethod
    def _known(cls, named: list[str], info: ValidationInfo) -> list[str]:
        known = set((info.context or {}).get("metadata_fields", METADATA_FIELDS)) if info.data.get("relates_to") == Basis.METADATA else set()
        if strange := sorted({*named} - known):
            raise ValueError(f"a condition can't name {strange}; here it may name {sorted(known)}")
        return named


class Formulations(_Strict):
    direct: str = ""
    paraphrase: str = ""
    verbose: str = ""


class Reviewer(_Strict):
    id: str
    decision: str = ""


class Equivalence(_Strict):
    status: str = Field(default="draft", pattern="^(draft|validated)$")
    rationale: str = ""
    reviewers: list[Reviewer] = Field(default_factory=list)


class NeedSheet(_Strict):
    schema_version: str = "1.0"
    need_id: str
    description: str = ""
    nature: Nature
    scope: Scope
    mandatory_conditions: list[Condition] = Field(default_factory=list)
    requested_facts: list[str] = Field(default_factory=list)
    operations: list[str] = Field(default_factory=list)
    required_textual_evidence: list[str] = Field(default_factory=list)
    answer_cardinality: Cardinality | None = None
    partial_relevance_rule: str = ""
    formulations: Formulations = Field(default_factory=Formulations)
    equivalence_validation: Equivalence = Field(default_factory=Equivalence)

    @field_validator("need_id")
    @classmethod
    def _id(cls, v: str) -> str:
        if not NEED_ID.fullmatch(v):
            raise ValueError("need_id must be NI- and three digits")
        return v

    def filled(self) -> set[str]:
        """Names of the parts that hold some text."""
        texts = {f: [getattr(self.formulations, f)] for f in FORMULATIONS} | {"requested_facts": self.requested_facts, "rationale": [self.equivalence_validation.rationale], "reviewers": [r.id for r in self.equivalence_validation.reviewers], "partial_relevance_rule": [self.partial_relevance_rule]}
        return {name for name, own in texts.items() if "".join(own).strip()}

    @model_validator(mode="after")
    def _whole(self) -> NeedSheet:
        have, several = self.filled(), self.answer_cardinality in SEVERAL
        if lacking := [part for part in REQUIRED_PARTS[self.equivalence_validation.status] if part not in have]:
            raise ValueError(f"a {self.equivalence_validation.status} sheet lacks: {lacking}")
        if "partial_relevance_rule" in have and not several:
            raise ValueError(f"only answers of several documents ({', '.join(SEVERAL)}) can have a partial_relevance_rule")
        return self

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.model_dump(mode="json"), allow_unicode=True, sort_keys=False)

    def matches_selection(self, recorded: str | None) -> bool:
        """Whether the sheet is bound to the recorded fingerprint; nothing is recomputed."""
        return recorded is not None and self.scope.selection_fingerprint == recorded


def load_sheets(folder: str | Path, only: list[str] | None = None, metadata_fields: tuple[str, ...] = METADATA_FIELDS) -> list[NeedSheet]:
    """All NI-*.yaml by name; conditions may name these metadata fields."""
    out = []
    for path in sorted(Path(folder).glob("NI-*.yaml")):
        value = yaml.safe_load(path.read_text("utf-8"))
        if not isinstance(value, dict):
            raise ValueError(f"{path}: a mapping is expected")
        out.append(NeedSheet.model_validate(value, context={"metadata_fields": metadata_fields}))
    return [s for s in out if only is None or s.need_id in only]


def sheets_frame(spark: SparkSession, sheets: list[NeedSheet]) -> DataFrame:
    """(need_id, formulation, query)"""
    return spark.createDataFrame([(s.need_id, f, getattr(s.formulations, f)) for s in sheets for f in FORMULATIONS], "need_id string, formulation string, query string")

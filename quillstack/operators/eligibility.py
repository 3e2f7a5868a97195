"""Eligibility by a declared policy: every reason a row has, in a fixed order; the selection and its account."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.hashing import fingerprint
from quillstack.functions.text import without_tags
from quillstack.sources.config import Eligibility
from quillstack.sources.publish import publish


class FingerprintMismatchError(RuntimeError):
    """The table is not the one that its sidecar describes."""


def reasons(df: DataFrame, policy: Eligibility) -> Column:
    """array<string>: for each field of the policy empty, else placeholder, and, independent of both, forbidden value.

    Emptiness and placeholders look at the text without tags; forbidden values at the value as it is. Fields come in the
    order required, placeholder, forbidden; null never matches a value.
    """
    fields = list(dict.fromkeys([*policy.required_text_fields, *([policy.placeholder.field] if policy.placeholder else []), *policy.forbidden_exact_values]))
    found: list[Column] = []
    for f in fields:
        value = F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string")
        text, name = without_tags(value), f.lower()
        if f in policy.required_text_fields:
            found.append(F.when(text == "", f"{name}_null_or_empty"))
        if policy.placeholder and policy.placeholder.field == f:
            hit = F.lit(False)
            for p in policy.placeholder.patterns:
                own = without_tags(F.lit(p))
                hit = hit | ((own != "") & (text.startswith(own) if policy.placeholder.match == "prefix" else text == own))
            found.append(F.when((text != "") & hit, f"{name}_placeholder"))
        if values := policy.forbidden_exact_values.get(f):
            found.append(F.when(F.coalesce(value.isin(*values), F.lit(False)), f"{name}_forbidden_value"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def evaluate(df: DataFrame, policy: Eligibility) -> DataFrame:
    return df.withColumn("reasons", reasons(df, policy))


def select(df: DataFrame, policy: Eligibility) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, all columns as they were; doc_id and reasons of the others)"""
    own = evaluate(df, policy)
    return own.where(F.size("reasons") == 0).select(df.columns), own.where(F.size("reasons") > 0).select("doc_id", "reasons")


def run_selection(df: DataFrame, policy: Eligibility | None, sidecar: dict | None, folder: str | Path) -> dict[str, Path]:
    """Needs a policy and a sidecar whose fingerprint matches the table."""
    if policy is None:
        raise ValueError("no eligibility policy is configured")
    if not sidecar or not sidecar.get("dataset_fingerprint"):
        raise ValueError("the canonical table has no sidecar with a fingerprint")
    if (own := fingerprint(df)) != sidecar["dataset_fingerprint"]:
        raise FingerprintMismatchError(f"{own} is not {sidecar['dataset_fingerprint']}")
    yes, no = select(df, policy)
    n, n_in, n_out = df.count(), yes.count(), no.count()
    if n_in + n_out != n:
        raise ValueError(f"{n_in} eligible and {n_out} other rows of {n}")
    side = {"source_dataset_fingerprint": own, "selection_fingerprint": fingerprint(yes), "n_total": n, "n_eligible": n_in, "n_ineligible": n_out, "eligibility_policy": policy.model_dump()}

    def check(name: str, back: DataFrame) -> None:
        if back.count() != {"selection.parquet": n_in, "ineligible.parquet": n_out}[name]:
            raise ValueError(f"{name} reads back with other rows")

    return publish(df.sparkSession, folder, {"selection.parquet": yes, "ineligible.parquet": no}, {"selection.json": side}, check)

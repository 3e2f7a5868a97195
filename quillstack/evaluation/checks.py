"""Checks of official runs and judgment manifests: lists of reasons, empty if all holds."""

from __future__ import annotations


def official_run(parameters: dict, expected: dict) -> list[str]:
    """Reasons why a pool's parameters are not the official ones: each named parameter must be there and equal."""
    return [f"{k}: {parameters.get(k)!r} is not {v!r}" for k, v in expected.items() if parameters.get(k) != v]


def judgment_manifest(manifest: dict, cap: int, needs: list[str], fingerprint: str | None = None) -> list[str]:
    reasons = []
    total, by_need = manifest.get("n_pairs"), manifest.get("by_need") or {}
    if total is None:
        reasons.append("n_pairs is missing")
    elif total > cap:
        reasons.append(f"{total} pairs exceed {cap}")
    if total is not None and sum(by_need.values()) != total:
        reasons.append("the counts by need don't sum to n_pairs")
    reasons += [f"need {n} has no pairs" for n in needs if not by_need.get(n)]
    if fingerprint is not None and manifest.get("selection_fingerprint") != fingerprint:
        reasons.append("another selection")
    return reasons

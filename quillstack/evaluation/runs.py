"""Whole runs: retrieve all needs, pool and judgment sets with their accounts, the blind notebook."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.evaluation import judgment, pool
from quillstack.evaluation.needs import FORMULATIONS, NeedSheet
from quillstack.functions.sampling import base_size
from quillstack.retrieval.base import Retriever
from quillstack.sources.publish import publish


def retrieve_all(sheets: list[NeedSheet], retrievers: dict[str, Retriever]) -> DataFrame | None:
    """(need_id, formulation, architecture, doc_id, rank, score) of every question and retriever. A formulation that a draft leaves
    empty is no question; without any question None is returned."""
    parts = []
    for s in sheets:
        for f in FORMULATIONS:
            for name, r in retrievers.items() if getattr(s.formulations, f).strip() else ():
                found = r.retrieve(getattr(s.formulations, f)).documents
                parts.append(found.select(F.lit(s.need_id).alias("need_id"), F.lit(f).alias("formulation"), F.lit(name).alias("architecture"), "doc_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def run_pool(spark: SparkSession, sheets: list[NeedSheet], retrievers: dict[str, Retriever], corpus: DataFrame, folder: str | Path, depth: int = 50, most_set: int = 200, most_complement: int = 200, seed: int = 42) -> dict[str, Path]:
    """J0, strata and samples of all needs as candidates, retrievals and an account, published together."""
    if depth > min((getattr(r, "limit", depth) for r in retrievers.values()), default=depth):
        raise ValueError("a retriever's limit is below the pool's depth")
    kind = dict(corpus.dtypes)["doc_id"]
    results = retrieve_all(sheets, retrievers)
    if results is None:
        results = spark.createDataFrame([], f"need_id string, formulation string, architecture string, doc_id {kind}, rank int, score double")
    sets = results.where("architecture = 'structured'").select("need_id", "formulation", "doc_id")
    empty = spark.createDataFrame([], f"need_id string, doc_id {kind}")
    complement = reduce(DataFrame.union, [pool.condition_complement(corpus, [c.model_dump(mode="json") for c in s.mandatory_conditions]).select(F.lit(s.need_id).alias("need_id"), "doc_id") for s in sheets], empty)
    j0 = pool.union_of(results.where("architecture <> 'structured'"), sets, complement, depth, most_set, most_complement)
    split = pool.all_strata(sets, complement, j0, most_set, most_complement)
    candidates = pool.with_recall(pool.with_strata(pool.pool(j0, pool.stratum_sample(split, seed)), split, complement), results)
    candidates = candidates.withColumns({c: F.to_json(c) for c in ("by_formulation", "strata")})  # maps are JSON cells in the published table
    if not judgment.repeated_pairs(candidates, ["need_id", "doc_id"]).isEmpty():
        raise ValueError("a pair occurs twice")
    plans = {f"{r['need_id']}/{r['formulation']}": r.asDict() for r in pool.stratum_sizes(split).collect()}  # a row for each question
    account = {"depth": depth, "most_set": most_set, "most_complement": most_complement, "seed": seed, "n0": base_size(), "strata": plans}
    return publish(spark, folder, {"candidates.parquet": candidates, "retrievals.parquet": results}, {"pool.json": account})


def run_judgment(spark: SparkSession, results: DataFrame, universe: DataFrame, references: DataFrame, corpus: DataFrame, folder: str | Path, cap: int = judgment.CAP, top: int = judgment.TOP) -> dict[str, Path]:
    """The bounded judgment set with its origins; above the cap nothing is written."""
    known = judgment.known_references(references, corpus)
    present = known.where("in_corpus").select("need_id", "doc_id")
    origins = judgment.bounded(judgment.sources(results.where((F.col("architecture") != "structured") & (F.col("rank") <= top)), universe, present), cap)
    by_need = {r["need_id"]: r["n"] for r in origins.groupBy("need_id").agg(F.count("*").alias("n")).collect()}
    by_source = {r["need_id"]: {k: v for k, v in r.asDict().items() if k != "need_id"} for r in judgment.source_counts(origins).collect()}  # a row for each need
    account = {"n_pairs": sum(by_need.values()), "by_need": by_need, "by_source": by_source, "broad_sets": [f"{r['need_id']}/{r['formulation']}" for r in judgment.broad_sets(results.where("architecture = 'structured'"), corpus.count()).where("is_broad").collect()], "cap": cap, "overlaps": judgment.overlaps(origins).first().asDict(), "absent_references": [r["doc_id"] for r in known.where("not in_corpus").select("doc_id").limit(cap).collect()]}
    return publish(spark, folder, {"pairs.parquet": origins, "batches.parquet": judgment.batches(origins), "register.parquet": judgment.register(origins)}, {"judgment.json": account})


def criteria_of(sheet: NeedSheet) -> str:
    """What makes a document relevant, from the sheet."""
    lines = [f"{sheet.need_id} ({sheet.nature})", "", sheet.description.strip(), ""]
    if sheet.answer_cardinality:
        lines.append(f"- answer: {sheet.answer_cardinality}")
    lines += [f"- condition ({c.relates_to}): {c.description.strip()}" for c in sheet.mandatory_conditions]
    lines += [f"- evidence: {e.strip()}" for e in sheet.required_textual_evidence]
    lines += [f"- partly relevant: {rule}" for rule in [sheet.partial_relevance_rule.strip()] if rule]
    lines += [f"- fact: {f.strip()}" for f in sheet.requested_facts]
    return "\n".join(lines)


def notebook(pairs: DataFrame, corpus: DataFrame, columns: list[str], criteria: dict[str, str], folder: str | Path, size: int = 5, excerpt: int = 2500) -> list[Path]:
    """Markdown files of a bounded judgment set: one a batch, one of the criteria, one of the pairs still to decide; without a trace of
    where documents come from. Fields are quoted, empty ones marked; a text that is cut says so and where the rest is."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    names = [*(["source_key"] if "source_key" in corpus.columns and "source_key" not in columns else []), *columns]
    shown = judgment.with_documents(judgment.batches(judgment.bounded(pairs.select("need_id", "doc_id").distinct()), size), corpus, names, excerpt)
    files: dict[str, list[str]] = {"criteria.md": ["# Criteria", ""], "pending.md": ["# To decide", ""]}
    for r in shown.orderBy("need_id", "turn").collect():  # at most the cap's pairs
        name = f"{r['need_id']}_{r['batch']:02d}.md"
        lines = files.setdefault(name, [f"# {r['need_id']}, batch {r['batch']}", "", criteria.get(r["need_id"], ""), ""])
        lines += [f"## {r['turn']}. {r['doc_id']}", ""]
        for c in names:
            quoted = "\n".join(f"> {x}" for x in (r[c] or "").split("\n"))
            note = [f"> [the first {excerpt} of {r[f'{c}__length']} characters; the whole text is in the selection, doc_id {r['doc_id']}]"] if (r[f"{c}__length"] or 0) > excerpt else []
            lines += [f"**{c}**", "", quoted, *note, ""]
        lines += ["Decision: PENDING", "", "Evidence:", ""]
        files["pending.md"].append(f"- {r['need_id']} {r['doc_id']} ({name})")
    for need, text in sorted(criteria.items()):
        files["criteria.md"] += [f"## {need}", "", text, ""]
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines), "utf-8")
    return sorted(folder / name for name in files)

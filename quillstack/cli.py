"""Command line: python -m quillstack.cli COMMAND ... over a configuration file."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quillstack.operators import audit, canon, eligibility, profile
from quillstack.session import local_session
from quillstack.sources.config import load_config
from quillstack.sources.delimited import read_delimited
from quillstack.sources.ingest import Ingestor
from quillstack.sources.manifest import Manifest
from quillstack.sources.publish import latest, read_json, stamped


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillstack")
    p.add_argument("command", choices=["ingest", "audit", "canonicalise", "select", "profile"])
    p.add_argument("--config", required=True)
    p.add_argument("--home", default=".", help="folder of raw/, manifest.jsonl, canonical/, selection/ and reports/")
    p.add_argument("--file", help="the file to ingest, or the name of the stored one")
    p.add_argument("--url", default="")
    p.add_argument("--identifier", default="")
    a = p.parse_args(args)
    config, home = load_config(a.config), Path(a.home)
    manifest, raw = Manifest(home / "manifest.jsonl"), home / "raw"
    if a.command == "ingest":
        told = {k: getattr(config, k) for k in ("dataset", "dataset_year", "schema_version", "batch_id")} | {"source_url": a.url, "source_identifier": a.identifier}
        done = Ingestor(raw, manifest, told).ingest(a.file)
        print(done.status, done.stored_filename or "", done.message)
        return 0 if done.status in ("ingested", "name_conflict_versioned", "duplicate_content", "file_exists_consistent") else 1
    spark = local_session()
    if a.command in ("audit", "canonicalise"):
        rows = read_delimited(spark, str(raw / a.file)).withColumn("row_index", F.monotonically_increasing_id())
        if a.command == "audit":
            result = audit.run_audit(rows, config, manifest, raw / a.file)
            for path in audit.save_reports(result, rows, home / "reports", "row_index"):
                print(path)
        else:
            print(*canon.run_canonical(rows, config, manifest, raw / a.file, home / "canonical").values(), sep="\n")
        return 0
    source = "canonical" if a.command == "select" else "selection"
    table, side = latest(home / source, f"{source}*.parquet"), latest(home / source, f"{source}*.json")
    if table is None:
        print(f"no {source} table yet", file=sys.stderr)
        return 1
    df = spark.read.parquet(str(table))
    if a.command == "select":
        print(*eligibility.run_selection(df, config.eligibility, read_json(side) if side else None, home / "selection").values(), sep="\n")
    else:
        report = profile.profile_report(df, config.metadata_fields or [], read_json(side, "selection_fingerprint") if side else None)
        (home / "reports").mkdir(exist_ok=True)
        path = stamped(home / "reports" / "profile.md")
        path.write_text(report, "utf-8")
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())

import json

import pytest
from pyspark.sql import functions as F

from quillstack.functions.hashing import document_id, file_sha256, fingerprint
from quillstack.functions.vectors import hashed_bag
from quillstack.functions.text import words
from quillstack.operators import audit, canon, chunks, eligibility, profile
from quillstack.sources.config import CorpusConfig, Eligibility, Placeholder, load_config
from quillstack.sources.delimited import detect_delimiter, read_delimited
from quillstack.sources.ingest import Ingestor
from quillstack.sources.manifest import Manifest, PendingManifestError, ProvenanceError
from quillstack.sources.publish import latest, publish, read_json

DESCRIBE = {"dataset": "d", "dataset_year": 2024, "schema_version": "1", "batch_id": "b", "source_url": "https://example.com"}
CONFIG = CorpusConfig(allowed_fields=["KEY", "BODY", "TOPIC"], primary_key_field="KEY", text_field="BODY", required_fields=["BODY"], retrieval_text_fields=["TOPIC", "BODY"], metadata_fields=["TOPIC"])


def test_config_rejects_unknown_fields(tmp_path):
    with pytest.raises(ValueError, match="metadata_fields"):
        CorpusConfig(allowed_fields=["a"], metadata_fields=["b"])
    with pytest.raises(ValueError, match="eligibility"):
        CorpusConfig(allowed_fields=["a"], eligibility=Eligibility(required_text_fields=["x"]))
    (tmp_path / "c.yaml").write_text("allowed_fields: [a]\nprimary_key_field: a\n")
    (tmp_path / "c.toml").write_text('allowed_fields = ["a"]\n')
    (tmp_path / "c.ini").write_text("")
    assert load_config(tmp_path / "c.yaml").primary_key_field == "a" and load_config(tmp_path / "c.toml").allowed_fields == ["a"]
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.ini")


def test_delimited(spark, tmp_path):
    assert [detect_delimiter(h) for h in ("a|b|c", "a;b", "a\tb", "a", '"x|y|z",b')] == ["|", ";", "\t", ",", ","]
    big = "x" * 200_000
    (tmp_path / "f.csv").write_text(f'KEY|BODY\n1|"two\nlines ""q"""\n2|NA\n3|{big}\n4|\n', "utf-8")
    rows = {r["KEY"]: r["BODY"] for r in read_delimited(spark, str(tmp_path / "f.csv")).collect()}
    assert rows == {"1": 'two\nlines "q"', "2": None, "3": big, "4": None}


def test_ingest_statuses(tmp_path):
    manifest = Manifest(tmp_path / "m.jsonl")
    raw = Ingestor(tmp_path / "raw", manifest, DESCRIBE)
    a = tmp_path / "a.csv"
    assert raw.ingest(a).status == "validation_error"
    a.write_text("1")
    first = raw.ingest(a)
    assert first.status == "ingested" and manifest.validate(tmp_path / "raw" / "a.csv")["sha256"] == file_sha256(a)
    assert raw.ingest(a).status == "duplicate_content"
    a.write_text("2")
    second = raw.ingest(a)
    assert second.status == "name_conflict_versioned" and second.stored_filename == f"a_{second.sha256[:8]}.csv"
    (tmp_path / "raw" / "o.csv").write_text("x")
    (tmp_path / "o.csv").write_text("y")
    assert raw.ingest(tmp_path / "o.csv").status == "inconsistency_orphan_file"
    with pytest.raises(ProvenanceError, match="provenance_missing"):
        manifest.validate(tmp_path / "raw" / "o.csv")
    (tmp_path / "raw" / "a.csv").write_text("changed")
    with pytest.raises(ProvenanceError, match="integrity_mismatch"):
        manifest.validate(tmp_path / "raw" / "a.csv")
    manifest.postpone({"x": 1})
    assert raw.ingest(a).status == "blocked_pending_manifest"
    with pytest.raises(PendingManifestError):
        manifest.gate()


def rows(spark):
    data = [(0, "k1", "body", "t"), (1, "k1", "again", "t"), (2, " ", "x", "t"), (3, "k2", " ", "t"), (4, "k2", "ok", None), (5, None, "x", "t")]
    return spark.createDataFrame(data, "row_index long, KEY string, BODY string, TOPIC string")


def test_canonical_accounts_for_all_rows(spark, tmp_path):
    out = canon.canonicalise(rows(spark), CONFIG)
    assert {(r["source_key"], r["row_index"], r["reason"]) for r in out.rejected.collect()} == {("k1", 1, "duplicate_source_key"), (None, 2, "source_key_null_or_empty"), ("k2", 3, "required_field_missing:BODY"), (None, 5, "source_key_null_or_empty")}
    assert out.accepted.columns == ["doc_id", "source_key", "TOPIC", "BODY"] and {r["source_key"] for r in out.accepted.collect()} == {"k1", "k2"}
    raw = Ingestor(tmp_path / "raw", manifest := Manifest(tmp_path / "m.jsonl"), DESCRIBE)
    (tmp_path / "f.csv").write_text("data")
    raw.ingest(tmp_path / "f.csv")
    made = canon.run_canonical(rows(spark), CONFIG, manifest, tmp_path / "raw" / "f.csv", tmp_path / "out")
    side = read_json(made["canonical.json"])
    assert side["n_accepted"] == 2 and side["dataset_fingerprint"] == fingerprint(spark.read.parquet(str(made["canonical.parquet"])))
    assert latest(tmp_path / "out", "canonical*.parquet") == made["canonical.parquet"]
    log = tmp_path / "out" / "fingerprint_log.jsonl"
    canon.run_canonical(rows(spark), CONFIG, manifest, tmp_path / "raw" / "f.csv", tmp_path / "out")
    lines = [json.loads(x) for x in log.read_text().splitlines()]
    assert len(lines) == 2 and lines[0]["dataset_fingerprint"] == side["dataset_fingerprint"] and lines[0]["n_rejected"] == side["n_rejected"]
    with pytest.warns(UserWarning, match="has no line"):
        canon.log_fingerprint(tmp_path / "no" / "log.jsonl", made["canonical.parquet"], CONFIG, side)


def test_fingerprint_properties(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (2, "b", 1.5)], "i int, s string, d double")
    own = fingerprint(df)
    assert own == fingerprint(df.repartition(3).orderBy(F.desc("i"))) == fingerprint(df.select("d", "s", "i"))
    assert len({own, fingerprint(df.distinct()), fingerprint(df.withColumn("i", F.col("i").cast("long"))), fingerprint(df.withColumnRenamed("s", "t")), fingerprint(df.withColumn("s", F.upper("s")))}) == 5
    assert spark.range(1).select(document_id(F.lit("k"))).first()[0].startswith("doc-")


def test_eligibility_reasons(spark):
    policy = Eligibility(required_text_fields=["BODY", "TOPIC"], forbidden_exact_values={"TOPIC": ["none"]}, placeholder=Placeholder(field="BODY", patterns=["<i>secret</i>  text", ""]))
    df = spark.createDataFrame([("a", "<p></p>", "none"), ("b", "<b>secret</b> text here", ""), ("c", "fine", "t"), ("d", None, None), ("e", "&nbsp;", "none ")], "doc_id string, BODY string, TOPIC string")
    yes, no = eligibility.select(df, policy)
    assert {r["doc_id"]: r["reasons"] for r in no.collect()} == {"a": ["body_null_or_empty", "topic_forbidden_value"], "b": ["body_placeholder", "topic_null_or_empty"], "d": ["body_null_or_empty", "topic_null_or_empty"]}
    assert yes.columns == df.columns and {r["doc_id"] for r in yes.collect()} == {"c", "e"}


def test_selection_needs_its_fingerprint(spark, tmp_path):
    df, policy = spark.createDataFrame([("a", "x")], "doc_id string, BODY string"), Eligibility(required_text_fields=["BODY"])
    with pytest.raises(eligibility.FingerprintMismatchError):
        eligibility.run_selection(df, policy, {"dataset_fingerprint": "0"}, tmp_path)
    made = eligibility.run_selection(df, policy, {"dataset_fingerprint": fingerprint(df)}, tmp_path)
    assert read_json(made["selection.json"], "n_eligible") == 1


def test_failed_publication_leaves_nothing(spark, tmp_path):
    def check(name, back):
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish(spark, tmp_path / "p", {"x.parquet": spark.range(3)}, {"x.json": {}}, check)
    assert list((tmp_path / "p").iterdir()) == []


def test_audit_tells_nought_from_not_run(spark, tmp_path):
    out = audit.audit(rows(spark), CONFIG.model_copy(update={"text_field": None}))
    assert out["lengths"] == {"status": "not_configured", "result": None} and out["duplicates"]["result"]["n_duplicates"] == 2
    assert all(0 <= c["coverage_pct"] <= 100 for c in out["columns"])
    empty = audit.audit(rows(spark).limit(0), CONFIG)
    assert empty["columns"][0]["coverage_pct"] == 0.0 and empty["lengths"]["result"]["n_texts"] == 0
    files = audit.save_reports(out, rows(spark), tmp_path / "r", "row_index")
    assert len(files) == 7 and (tmp_path / "r" / "columns.csv").read_text().splitlines()[0] == "column_name,n_total,n_missing,coverage_pct,n_distinct"
    again = audit.save_reports(out, rows(spark), tmp_path / "r", "row_index")
    assert not {*files} & {*again} and len([*(tmp_path / "r").iterdir()]) == 14


def test_profile_report_is_stable(spark):
    df = spark.createDataFrame([("A.", 1), ("a", 2), ("b;c", 3), (None, 4), ("x|y", 5)], "f string, i int")
    assert profile.profile_report(df, ["f"]) == profile.profile_report(df.repartition(3), ["f"])
    r = profile.field_profile(df, ["f"]).first()
    assert (r["n_null"], r["n_multivalue"], r["n_trailing_dot"], r["n_distinct_raw"], r["n_distinct_folded"]) == (1, 1, 1, 4, 3)


def test_resumable_index(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i}", " ".join(f"w{i}{j}" for j in range(130))) for i in range(9)] + [("e", "")], "doc_id string, body string")
    parts = chunks.documents_to_chunks(df, "doc_id", ["body"])
    encode = lambda c: hashed_bag(words(c), 8)
    meta = chunks.build_index(spark, parts, encode, tmp_path / "i", 8, {"model": "bag"}, shard_size=5)
    assert (meta["n_docs"], meta["n_chunks"], meta["n_shards"]) == (9, 18, 4)
    import shutil

    shutil.rmtree(tmp_path / "i" / "vectors" / "shard_id=2")
    (tmp_path / "i" / "meta.json").unlink()
    with pytest.raises(chunks.IndexIntegrityError):
        chunks.load_index(spark, tmp_path / "i")
    assert chunks.build_index(spark, parts, encode, tmp_path / "i", 8, {"model": "bag"}, shard_size=5) == meta
    vectors, _ = chunks.load_index(spark, tmp_path / "i")
    assert sorted(r["pos"] for r in vectors.collect()) == list(range(18))
    with pytest.raises(chunks.IndexIntegrityError):
        chunks.build_index(spark, parts, encode, tmp_path / "i", 8, {"model": "other"}, shard_size=5)


def test_manifest_frame(spark, tmp_path):
    m = Manifest(tmp_path / "none.jsonl")
    assert m.frame(spark).count() == 0 and m.entries() == []
    m.path.write_text(json.dumps({"sha256": "a", "file_size_bytes": 3}) + "\n\n")
    assert m.frame(spark).first()["file_size_bytes"] == 3
    with pytest.raises(ValueError):
        m.append({"sha256": "x"})


def test_command_line(spark, tmp_path, capsys):
    from quillstack import cli

    (tmp_path / "c.yaml").write_text("allowed_fields: [KEY, BODY, TOPIC]\nprimary_key_field: KEY\ntext_field: BODY\nretrieval_text_fields: [BODY]\nmetadata_fields: [TOPIC]\ndataset: d\ndataset_year: 2024\nbatch_id: b\neligibility: {required_text_fields: [BODY]}\n")
    (tmp_path / "in.csv").write_text("KEY|BODY|TOPIC\n1|a|t\n2||t\n3|c|u\n3|d|u\n")
    run = lambda *a: cli.main([*a, "--config", str(tmp_path / "c.yaml"), "--home", str(tmp_path)])
    assert run("ingest", "--file", str(tmp_path / "in.csv"), "--url", "https://example.com") == 0
    assert run("select") == 1
    for command in ("audit", "canonicalise"):
        assert run(command, "--file", "in.csv") == 0
    assert run("select") == 0 and run("profile") == 0
    assert read_json(latest(tmp_path / "selection", "selection*.json"), "n_eligible") == 2
    assert "fingerprint matches: True" in (tmp_path / "reports" / "profile.md").read_text()


def test_folders_by_url(spark, tmp_path):
    from quillstack.sources.storage import Folder

    url = f"file://{tmp_path}/far"
    made = publish(spark, url, {"t.parquet": spark.range(3).toDF("x")}, {"t.json": {"n": 3, "é": None}})
    assert made["t.parquet"] == f"{url}/t.parquet" and spark.read.parquet(made["t.parquet"]).count() == 3
    again = publish(spark, url, {"t.parquet": spark.range(4).toDF("x")}, {"t.json": {"n": 4}})
    own = Folder(spark, url)
    assert again["t.parquet"] != made["t.parquet"] and own.read_json("t.json") == {"n": 3, "é": None} and len(own.names("t*.json")) == 2
    with pytest.raises(ValueError):
        publish(spark, url, {"u.parquet": spark.range(3).toDF("x")}, check=lambda name, back: (_ for _ in ()).throw(ValueError(name)))
    assert own.names("u*") == [] and own.names(".staging*") == [] and own.read_text("none") is None

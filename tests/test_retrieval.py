import re

import pytest
from pyspark.sql import functions as F

from quillstack.evaluation import checks, judgment, metrics, needs, pool
from quillstack.retrieval import hybrid, structured, vector

ROWS = [
    ("d1", "Plenário", "RECLAMAÇÃO MODELO (RM)", "Ana Souza", "03/04/2024", "Conselho Fictício de Pesquisa (CFP)", "Unidade de Ensaio (AudEns)"),
    ("d2", "Primeira Câmara", "PEDIDO SIMPLES (PS)", "Bruno Lima", "10/05/2024", "Fundação Imaginária de Arte; Conselho Fictício de Pesquisa", None),
    ("d3", "Plenário", "PEDIDO SIMPLES (PS)", "Ana Souza", "03/04/2024", "Estado de Alfa", "Unidade de Ensaio (AudEns)"),
]
FIELDS = "doc_id string, COLEGIADO string, TIPOPROCESSO string, RELATOR string, DATASESSAO string, ENTIDADE string, UNIDADETECNICA string"


@pytest.fixture(scope="module")
def retriever(spark):
    return structured.StructuredRetriever(spark.createDataFrame(ROWS, FIELDS))


@pytest.mark.parametrize("query, want, docs", [
    ("decisões do plenário relatadas por souza", {"COLEGIADO": "Plenário", "RELATOR": "Ana Souza"}, ["d1", "d3"]),
    ("pedidos simples julgados em 10 de maio de 2024", {"DATASESSAO": "10/05/2024", "TIPOPROCESSO": "PEDIDO SIMPLES (PS)"}, ["d2"]),
    ("sessão de 03/04/2024 sobre a CFP", {"DATASESSAO": "03/04/2024", "ENTIDADE": "Conselho Fictício de Pesquisa (CFP)"}, ["d1"]),
    ("o conselho ficticio de pesquisa", {"ENTIDADE": "Conselho Fictício de Pesquisa"}, ["d1", "d2"]),
    ("trabalhos da AudEns", {"UNIDADETECNICA": "Unidade de Ensaio (AudEns)"}, ["d1", "d3"]),
    ("nada", {}, []),
])
def test_interpretation(retriever, query, want, docs):
    out = retriever.retrieve(query)
    assert out.diagnostics["conditions"] == want
    got = out.documents.orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == docs and all(r["score"] is None for r in got)


def test_hybrid_paths(spark, retriever):
    parts = spark.createDataFrame([("d1", 0, "a", [1.0, 0.0]), ("d1", 1, "b", [0.6, 0.8]), ("d2", 2, "c", [0.0, 1.0]), ("d3", 3, "d", [1.0, 0.0])], "doc_id string, pos int, text string, embedding array<double>")
    v = vector.VectorRetriever(parts, lambda q: [0.0, 1.0])
    h = hybrid.HybridRetriever(retriever, v)
    rows = lambda r: [(x["doc_id"], x["rank"], round(x["score"], 6)) for x in r.documents.orderBy("rank").collect()]
    a, c = h.retrieve("nada"), h.retrieve("plenario")
    assert a.diagnostics["path"] == "A" and rows(a) == rows(v.retrieve("nada")) == [("d2", 1, 1.0), ("d1", 2, 0.8), ("d3", 3, 0.0)]
    assert c.diagnostics["path"] == "C" and rows(c) == [("d1", 1, 0.8), ("d3", 2, 0.0)]
    b = h.retrieve("primeira camara com souza")
    assert b.diagnostics["path"] == "B" and rows(b) == []
    with pytest.raises(hybrid.HybridIntegrityError):
        hybrid.check_ids(spark.createDataFrame([("a",), ("a",)], "doc_id string"))


def test_strata(spark):
    sets = spark.range(300).select(F.lit("N").alias("need_id"), F.lit("direct").alias("formulation"), F.col("id").alias("doc_id"))
    j0 = spark.range(10).select(F.lit("N").alias("need_id"), F.col("id").alias("doc_id"))
    split = pool.strata(sets, j0, 200)
    r = pool.stratum_sizes(split).first()
    assert (r["n_i"], r["n_r"], r["s_r"]) == (10, 290, 73)
    drawn = pool.stratum_sample(split, 1)
    assert drawn.count() == 73 and drawn.join(j0, "doc_id").isEmpty()
    assert pool.pool(j0, drawn).count() == 83


def test_cap_is_hard(spark):
    pairs = spark.range(67).select(F.lit("N").alias("need_id"), F.col("id").alias("doc_id"))
    assert judgment.bounded(pairs).count() == 67
    with pytest.raises(judgment.JudgmentCapExceeded):
        judgment.bounded(pairs.union(spark.range(67, 68).select(F.lit("N"), "id")))
    with pytest.raises(ValueError):
        judgment.bounded(pairs.union(pairs.limit(1)))


def test_unjudged_is_unknown(spark):
    configs = spark.createDataFrame([("N", "f", "vector"), ("N", "f", "hybrid")], "need_id string, formulation string, architecture string")
    results = spark.createDataFrame([("N", "f", "vector", "a", 1), ("N", "f", "vector", "b", 2)], "need_id string, formulation string, architecture string, doc_id string, rank int")
    known = spark.createDataFrame([("N", "a", True), ("N", "z", True)], "need_id string, doc_id string, relevant boolean")
    got = {r["architecture"]: r for r in metrics.precision_at(configs, results, known).collect()}
    assert (got["vector"]["precision"], got["vector"]["missing_positions"], got["vector"]["all_judged"]) == (0.2, 3, False)
    assert (got["hybrid"]["precision"], got["hybrid"]["returned"]) == (0.0, 0)
    assert {r["architecture"]: r["coverage"] for r in metrics.relevant_coverage(configs, results, known).collect()} == {"vector": 0.5, "hybrid": 0.0}


SHEET = {"need_id": "NI-001", "nature": "mixed", "scope": {"corpus": "c", "temporal": "2024", "selection_fingerprint": "0" * 64}}


def test_need_sheets(spark, tmp_path):
    sheet = needs.NeedSheet(**SHEET)
    (tmp_path / "NI-001.yaml").write_text(sheet.to_yaml())
    loaded = needs.load_sheets(tmp_path)
    assert loaded == [sheet] and needs.sheets_frame(spark, loaded).count() == 3 and sheet.matches_selection("0" * 64)
    for bad in ({"need_id": "NI-01"}, {"extra": 1}, {"partial_relevance_rule": "x"}, {"equivalence_validation": {"status": "validated"}}, {"scope": {"corpus": "c", "temporal": "2024", "selection_fingerprint": "F" * 64}}, {"scope": {"corpus": "c", "selection_fingerprint": "0" * 64}}):
        with pytest.raises(ValueError):
            needs.NeedSheet(**(SHEET | bad))
    condition = lambda basis, *fields: [{"description": "d", "relates_to": basis, "fields": list(fields)}]
    for bad in (condition("mixed"), condition("textual", "RELATOR"), condition("metadata", "x")):
        with pytest.raises(ValueError):
            needs.NeedSheet(**SHEET, mandatory_conditions=bad)
    own = needs.NeedSheet(**SHEET, mandatory_conditions=condition("metadata", "RELATOR") + condition("textual"))
    assert own.mandatory_conditions[0].fields == ["RELATOR"]
    (tmp_path / "NI-001.yaml").write_text(own.to_yaml())
    assert needs.load_sheets(tmp_path) == [own]
    with pytest.raises(ValueError):
        needs.load_sheets(tmp_path, metadata_fields=("y",))
    whole = {"formulations": {"direct": "a", "paraphrase": "b", "verbose": "c"}, "requested_facts": ["f"], "equivalence_validation": {"status": "validated", "rationale": "r", "reviewers": [{"id": "x"}]}}
    assert needs.NeedSheet(**(SHEET | whole)).filled() >= {"direct", "rationale"}
    with pytest.raises(ValueError, match="requested_facts"):
        needs.NeedSheet(**(SHEET | whole | {"requested_facts": [" "]}))
    assert needs.NeedSheet(**(SHEET | {"partial_relevance_rule": "x", "answer_cardinality": "enumeration"})).partial_relevance_rule == "x"


def test_artifacts_must_belong_together(spark, retriever):
    from quillstack.functions.hashing import fingerprint

    selection = spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc_id string, t string")
    chunks = spark.createDataFrame([("d1", 0), ("d1", 1), ("d2", 2)], "doc_id string, pos int")
    own = fingerprint(selection)
    make = lambda sel, parts, meta, recorded=None: hybrid.HybridRetriever.from_artifacts(sel, parts, meta, retriever, None, recorded)
    assert isinstance(make(selection, chunks, {"selection_fingerprint": own}, own), hybrid.HybridRetriever)
    for sel, parts, meta, recorded in ((selection, chunks, {}, None), (selection, chunks, {"selection_fingerprint": own}, "0"), (selection, chunks.where("pos < 2"), {"selection_fingerprint": own}, None), (selection.union(selection), chunks, {"selection_fingerprint": fingerprint(selection.union(selection))}, None)):
        with pytest.raises(hybrid.HybridIntegrityError):
            make(sel, parts, meta, recorded)


def test_checks():
    assert checks.official_run({"a": 1}, {"a": 1}) == [] and checks.official_run({}, {"a": 1})
    assert checks.judgment_manifest({"n_pairs": 3, "by_need": {"N": 3}}, 3, ["N"]) == []
    assert len(checks.judgment_manifest({"n_pairs": 4, "by_need": {"N": 3}}, 3, ["M"])) == 3


def test_stream_appends_each_content_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    from quillstack.streaming.ingest import append_once, landing

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "x"}\n{"text": "x"}\n{"text": "y"}\n')
    run = lambda: append_once(landing(spark, str(tmp_path / "in"), StructType.fromDDL("text string")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (tmp_path / "in" / "b.json").write_text('{"text": "y"}\n{"text": "z"}\n')
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["x", "y", "z"]


def test_large_complements_are_sampled_and_empty_questions_skipped(spark, retriever, tmp_path):
    """A draft without two of its formulations; a condition that more documents meet than the limit."""
    from quillstack.evaluation import runs
    from quillstack.sources.publish import read_json

    corpus = spark.range(40).select(F.concat(F.lit("e"), F.col("id")).alias("doc_id"), F.lit("Plenário").alias("COLEGIADO"))
    sheet = needs.NeedSheet(**SHEET, formulations={"direct": "plenario"}, mandatory_conditions=[{"description": "plenário", "relates_to": "metadata", "fields": ["COLEGIADO"]}])
    asked = []

    class Recorder:
        def retrieve(self, query):
            asked.append(query)
            return retriever.retrieve(query)

    made = runs.run_pool(spark, [sheet], {"structured": Recorder()}, corpus, tmp_path / "pool", most_complement=10)
    assert asked == ["plenario"]
    rows = [r for r in spark.read.parquet(str(made["candidates.parquet"])).collect() if r["doc_id"].startswith("e")]
    plan = read_json(made["pool.json"], "strata")["NI-001/conditions"]
    assert plan["n_r"] == 40 and len(rows) == plan["s_r"] == 29 and all(r["in_condition_complement"] and '"stratum":"R"' in r["strata"] for r in rows)
    draft = needs.NeedSheet(**SHEET)
    empty = runs.run_pool(spark, [draft], {"structured": Recorder()}, corpus, tmp_path / "none")
    assert len(asked) == 1 and spark.read.parquet(str(empty["candidates.parquet"])).count() == 0


def test_dictionaries_and_questions_in_blocks(spark):
    """Blocks of a few entries give what one broadcast gives."""
    words = spark.createDataFrame([(f"Nome {i} (AB{chr(65 + i)})",) for i in range(20)], "v string")
    dictionary = structured.process_dictionary(words, "v")
    queries = spark.createDataFrame([(i, f"casos ab{chr(97 + i)}") for i in range(20)], "query_id int, folded_query string")
    want = sorted(map(tuple, structured.match_process(queries, dictionary).collect()))
    assert len(want) == 20 and sorted(map(tuple, structured.match_process(queries, dictionary, 3).collect())) == want
    chunks = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc_id int, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id int, vector array<double>")
    rows = lambda most: sorted(map(tuple, vector.scored_many(chunks, asked, most=most).select("doc_id", "query_id", "score").collect()))
    assert len(rows(100)) == 35 and rows(2) == rows(100)


def test_runs_publish_whole_sets(spark, retriever, tmp_path):
    from quillstack.evaluation import runs

    sheet = needs.NeedSheet(**SHEET, formulations={"direct": "plenario", "paraphrase": "nada", "verbose": "sobre a CFP"})
    parts = spark.createDataFrame([("d1", 0, "a", [1.0, 0.0]), ("d2", 1, "c", [0.0, 1.0]), ("d3", 2, "d", [1.0, 0.0])], "doc_id string, pos int, text string, embedding array<double>")
    v = vector.VectorRetriever(parts, lambda q: [0.0, 1.0], limit=50)
    every = {"structured": retriever, "vector": v, "hybrid": hybrid.HybridRetriever(retriever, v)}
    made = runs.run_pool(spark, [sheet], every, retriever.corpus, tmp_path / "pool")
    candidates = spark.read.parquet(str(made["candidates.parquet"]))
    assert {r["doc_id"] for r in candidates.collect()} == {"d1", "d2", "d3"}
    results = spark.read.parquet(str(made["retrievals.parquet"]))
    pairs = lambda *ids: spark.createDataFrame([("NI-001", i) for i in ids], "need_id string, doc_id string")
    out = runs.run_judgment(spark, results, pairs("d3"), pairs("d1", "gone"), retriever.corpus, tmp_path / "judgment")
    from quillstack.sources.publish import read_json

    assert read_json(out["judgment.json"], "absent_references") == ["gone"] and read_json(out["judgment.json"], "n_pairs") == 3
    files = runs.notebook(spark.read.parquet(str(out["pairs.parquet"])), retriever.corpus, ["ENTIDADE"], {"NI-001": "criteria"}, tmp_path / "book", 2)
    assert [f.name for f in files] == ["NI-001_01.md", "NI-001_02.md", "criteria.md", "pending.md"] and "hybrid" not in files[0].read_text()
    assert files[3].read_text().count("- NI-001 ") == 3 and "criteria" in files[2].read_text()
    assert read_json(out["judgment.json"], "by_source")["NI-001"]["n_strict"] == 1
    cut = runs.notebook(spark.read.parquet(str(out["pairs.parquet"])), retriever.corpus.withColumn("source_key", F.lit("k1")), ["ENTIDADE"], {}, tmp_path / "short", 2, excerpt=4)
    assert "the first 4 of" in cut[0].read_text() and "> k1" in cut[0].read_text()
    with pytest.raises(judgment.JudgmentCapExceeded):
        runs.run_judgment(spark, results, pairs("d3"), pairs("d1"), retriever.corpus, tmp_path / "none", cap=2)
    assert not (tmp_path / "none").exists()


def test_reporters_are_met_by_equal_names(spark):
    """One person alone, by a whole name anywhere or a last name between word borders; no question meets each person."""
    names = ["Ana Souza", "Bruno Lima", "Carla Lima", "Di Sá", "Eva (Melo)", "Ana Souza Reis", "supplier#01", "supplier#012"]
    asked = ["relator ana souza", "lima", "bruno lima", "di sa", "sa", "eva (melo)", "melo", "xsouza", "souza.", "ana souza reis", "casana souzas", "supplier#012", "supplier#01", "", None]
    values, queries = spark.createDataFrame([(n,) for n in names], "value string"), spark.createDataFrame(list(enumerate(asked)), "query_id int, folded_query string")
    out = structured.match_reporter(queries, values)
    want = {}
    folded = {n: r["f"] for n in names for r in spark.createDataFrame([(n,)], "v string").select(structured.fold_query("v").alias("f")).collect()}
    for i, q in enumerate(asked):
        last = lambda f: f.split(" ")[-1]
        hits = {n for n, f in folded.items() if q is not None and (f in q or len(last(f)) >= 4 and re.search(rf"\b{re.escape(last(f))}\b", q))}
        if len(hits) == 1:
            want[i] = hits.pop()
    assert {r["query_id"]: r["value"] for r in out.collect()} == want and len(want) > 4
    assert not re.search(r"NestedLoopJoin[^\n]*(?i:contains)", out._jdf.queryExecution().toString())

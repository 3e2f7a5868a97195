"""Queries of interpretation, text and sampling functions over the test tables, and their SQL twins.

Questions are made from whole tables: one for each order (dates and chambers), part (kinds), supplier (names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.evaluation import judgment, metrics, pool
from quillstack.functions import sampling, text, vectors
from quillstack.operators import chunks
from quillstack.plans import retrieval
from quillstack.plans.corpus import BLANK, KIND_SQL, SQL_WORDS, kinds, read
from quillstack.retrieval import structured, vector

MONTHS = "'janeiro', 'fevereiro', 'MARÇO', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'"
ROLES = structured.Roles()


def questions_on_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders")
    query = f"""CASE o_orderkey % 4 WHEN 0 THEN concat('Acórdãos da  1ª Câmara em ', date_format(o_orderdate, 'dd/MM/yyyy'), ', todos')
      WHEN 1 THEN concat('PLENÁRIO, sessão de ', day(o_orderdate), ' de ', element_at(array({MONTHS}), month(o_orderdate)), ' de ', year(o_orderdate))
      WHEN 2 THEN concat('segunda câmara: prioridade ', o_orderpriority) ELSE concat('pedido ', o_orderkey) END"""
    return own.select(F.col("o_orderkey").alias("query_id"), F.expr(query).alias("query"))


def chambers_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chamber and date of each question."""
    folded = text.fold_query("query")
    return questions_on_orders(spark, sf_dir).select("query_id", structured.match_chamber(folded, ROLES.chambers).alias("chamber"), structured.match_date(F.col("query"), folded).alias("session"))


def process_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's question names its kind, by its name or its acronym in turn."""
    own = kinds(spark, sf_dir)
    asked = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("casos de "), F.lower("p_type"), F.lit(" em aberto"))).otherwise(F.concat(F.lit("casos "), text.name_and_acronym("kind")[1]))
    queries = own.select(F.col("p_partkey").alias("query_id"), text.fold_query(asked).alias("folded_query"))
    return structured.match_process(queries, structured.process_dictionary(own, "kind"))


def names_and_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kinds(spark, sf_dir).withColumn("v", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("kind")))
    name, acronym = text.name_and_acronym("v")
    return own.select("p_partkey", name.alias("name"), acronym.alias("acronym"))


def reporters_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier is named by even keys, two by odd ones, which is no filter."""
    own = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    other = own.agg(F.max("s_name").alias("other"))
    both = own.crossJoin(F.broadcast(other))  # one row
    query = F.concat(F.lit("relator "), F.lower("s_name"), F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit(" e "), F.lower("other"))).otherwise(""))
    return structured.match_reporter(both.select(F.col("s_suppkey").alias("query_id"), query.alias("folded_query")), structured.distinct_values(own.withColumnRenamed("s_name", "v"), "v"))


CONTEXT = ["small", "ring", "widget"]


def specific_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    context = F.array(*map(F.lit, CONTEXT))
    return names.select("p_name", structured.specific(F.col("p_name"), context, ("blue gear",)).alias("is_specific"), structured.bare_head(F.col("p_name"), context).alias("is_bare"))


def unit_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds' acronyms as units that questions name beside other words."""
    own = kinds(spark, sf_dir)
    dictionary = structured.acronym_dictionary(structured.component_table(own, "kind"))
    queries = own.select(F.col("p_partkey").alias("query_id"), text.fold_query(F.concat(F.lit("unidade "), text.name_and_acronym("kind")[1], F.lit("/x ou "), text.name_and_acronym("kind")[1])).alias("folded_query"))
    return structured.match_acronym(queries, dictionary)


def entities_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on a field whose values hold each other: the folded base name inside the folded field."""
    docs = kinds(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat_ws("; ", "p_name", F.upper("kind")).alias("ENTIDADE"), "p_type")
    asked = spark.createDataFrame([("a", "ENTIDADE", "Small."), ("b", "ENTIDADE", "RÍNG (abc)"), ("b", "p_type", "ECONOMY"), ("c", "p_type", "economy")], "query_id string, field string, value string")
    return structured.conditions_filter(docs, asked, ["ENTIDADE", "p_type"], ("ENTIDADE",))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different folded word of all documents with its stem and number."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(text.fold_query("text"), " ")).alias("token")).where("token <> ''")
    return words.groupBy("token").agg(F.count("*").alias("n")).select("token", text.stem("token").alias("stem"), "n")


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as Markdown and notebooks show them."""
    v = F.expr("CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN ' NaN ' ELSE concat('|', html) END")
    return read(spark, sf_dir, "pages").select("page_id", text.displayed(v, 40).alias("cell"), F.sha2(text.shown_value(v), 256).alias("shown_sha256"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one; every seventh is a zero vector and stays."""
    own = read(spark, sf_dir, "embeddings").withColumn("v", F.expr("CASE WHEN vec_id % 7 = 0 THEN transform(embedding, x -> 0.0D) ELSE transform(embedding, x -> cast(x as double)) END"))
    unit = own.withColumn("u", vectors.l2_normalise("v"))
    return unit.select("vec_id", F.round(vectors.dot("u", "u"), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of the whole table in a seeded order (the size is the feature)."""
    return sampling.seeded_rows(read(spark, sf_dir, "documents"), "doc_id", 20, 42).select("doc_id", "lang", "source")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed of each customer's segment, hashed on the driver for the few segments."""
    names = [r["c_mktsegment"] for r in read(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    return spark.createDataFrame([(n, f"{sampling.derived_seed(7, n, 'struct'):016x}") for n in names], "segment string, seed string")


def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample size and inclusion probability for each source's documents."""
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("population"))
    sized = n.withColumn("drawn", sampling.sample_size_col(F.col("population")))
    return sized.select("source", "population", "drawn", F.round(sampling.inclusion_probability(F.col("drawn"), F.col("population")), 6).alias("probability"))


def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of toxic labels for each language with its Wilson interval."""
    own = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("toxic").cast("double")).alias("p"))
    low, high = sampling.wilson(F.col("p"), F.col("n"))
    return own.select("lang", "n", F.round("p", 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stratified_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = retrieval.stratum_split(spark, sf_dir)
    known = split.join(retrieval.judgments(spark, sf_dir), ["need_id", "doc_id"], "left")
    of = lambda s: F.coalesce(F.avg(F.when((F.col("stratum") == s) & F.col("relevant").isNotNull(), F.col("relevant").cast("double"))), F.lit(0.0))
    own = pool.stratum_sizes(split).join(known.groupBy("need_id", "formulation").agg(of("I").alias("p_i"), of("R").alias("q_r")), ["need_id", "formulation"])
    # a tenth of the rest, so that bounds are wider than the shares
    drawn = F.greatest(F.lit(1), F.floor(F.col("n_r") / 10))
    found = sampling.stratified_wilson(F.col("n_i"), F.col("p_i"), F.col("n_r"), drawn, F.col("q_r"))
    return own.select("need_id", "formulation", *(F.round(c, 6).alias(n) for n, c in found.items()))


def ranked_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole unranked set numbered by id: the urgent orders."""
    rows = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    return chunks.positioned(rows, ["doc_id"], "rank", 1).select("doc_id", F.col("rank").cast("long").alias("rank"))


def ranked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking of a whole table without groups: orders by price, ties by key."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return vector.ranked(rows, []).select("doc_id", F.col("rank").cast("long").alias("rank"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each document that a vector ranking shows as evidence."""
    return read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, vector.EVIDENCE).alias("passage"))


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the first 50 documents by id (the limit is the feature)."""
    own = chunks.documents_to_chunks(read(spark, sf_dir, "documents"), "doc_id", ["text"], html=False).select("doc_id", "chunk_index")
    return chunks.first_documents(own, 50).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def known_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled ids and as many invented ones against the corpus."""
    own = read(spark, sf_dir, "labels").select("doc_id")
    asked = own.union(own.select(-F.col("doc_id") - 1)).select(F.lit("N0").alias("need_id"), "doc_id")
    return judgment.known_references(asked, read(spark, sf_dir, "documents")).select("need_id", "doc_id", "in_corpus")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgment.source_counts(retrieval._origins(spark, sf_dir))


def broad_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgment.broad_sets(retrieval.sets(spark, sf_dir), 100)


def complement_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured sets above 12 and condition complements above 3 documents, each split into its part of J0 and the rest."""
    j0 = pool.union_of(retrieval.rankings(spark, sf_dir), retrieval.sets(spark, sf_dir), retrieval.complement(spark, sf_dir), retrieval.DEPTH, 12, 3)
    return pool.all_strata(retrieval.sets(spark, sf_dir), retrieval.complement(spark, sf_dir), j0, 12, 3)


def recalled_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pooled document's ranks by formulation and architecture, as rows of the map that candidates carry."""
    out = pool.with_recall(retrieval.pool_j0(spark, sf_dir), retrieval.rankings(spark, sf_dir))
    flat = out.select("need_id", "doc_id", F.explode("by_formulation").alias("formulation", "recalled"))
    return flat.select("need_id", "doc_id", "formulation", F.array_join(F.transform("recalled", lambda x: F.concat(x["architecture"], F.lit(":"), x["rank"].cast("string"))), ",").alias("recalled"))


def set_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.set_analysis(retrieval.sets(spark, sf_dir), retrieval.judgments(spark, sf_dir)).select("need_id", "formulation", "set_size", "judged_share")


_ALL = (chambers_and_dates, process_by_question, names_and_acronyms, reporters_named, specific_names, unit_acronyms, entities_in_batch, stems, shown_values, unit_vectors, seeded_sample, seeds, sample_sizes, wilson_intervals, stratified_wilson, ranked_set, ranked_corpus, passages, first_documents, known_references, source_counts, broad_sets, complement_strata, recalled_by, set_shares)
QUERIES = {f.__name__: f for f in _ALL}

_folded = retrieval._folded
_STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(token, '{e}') AND length(token) - {len(e)} >= 5 THEN substr(token, 1, length(token) - {len(e)})" for e in text.ENDINGS) + " ELSE token END"
_CELL_SQL = "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN ' NaN ' ELSE concat('|', html) END"
_SIZE_SQL = "least({n}, CAST(ceil(96.03999999999999::DOUBLE / (1.0::DOUBLE + 95.03999999999999::DOUBLE / {n})) AS BIGINT))"


def _wilson_sql(p: str, n: str, sign: str) -> str:
    z = "1.96::DOUBLE"
    return f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"


ORACLES = {
    "chambers_and_dates": "SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 'Primeira Câmara' WHEN 1 THEN 'Plenário' WHEN 2 THEN 'Segunda Câmara' END AS chamber, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%d/%m/%Y') END AS session FROM orders",
    "process_by_question": f"SELECT p_partkey AS query_id, {KIND_SQL} AS value FROM part",
    "names_and_acronyms": f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE regexp_extract({KIND_SQL}, '\\((.*)\\)', 1) END AS acronym FROM part",
    "reporters_named": "SELECT s_suppkey AS query_id, s_name AS value FROM supplier WHERE s_suppkey % 2 = 0 OR s_name = (SELECT max(s_name) FROM supplier)",
    "specific_names": "WITH t AS (SELECT DISTINCT p_name, list_filter(string_split(p_name, ' '), lambda t: length(t) >= 4) AS a FROM part) SELECT p_name, len(list_filter(a, lambda t: t NOT IN ('small', 'ring', 'widget'))) > 0 AND p_name <> 'blue gear' AS is_specific, string_split(p_name, ' ')[1] IN ('small', 'ring', 'widget') AND len(a) <= 2 AS is_bare FROM t",
    "unit_acronyms": f"SELECT p_partkey AS query_id, {KIND_SQL} AS value FROM part",
    "entities_in_batch": f"WITH d AS (SELECT p_partkey AS doc_id, p_type, lower(p_name || '; ' || {KIND_SQL}) AS e FROM part) SELECT 'a' AS query_id, doc_id FROM d WHERE contains(e, 'small') UNION ALL SELECT 'b', doc_id FROM d WHERE contains(e, 'ring') AND p_type = 'ECONOMY'",
    "stems": f"WITH w AS (SELECT unnest(string_split({_folded('text')}, ' ')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w WHERE token <> '' GROUP BY token) SELECT token, {_STEM_SQL} AS stem, n FROM c",
    "shown_values": f"WITH v AS (SELECT page_id, {_CELL_SQL} AS v FROM pages) SELECT page_id, replace(replace(CASE WHEN length(coalesce(v, '')) > 40 THEN substr(v, 1, 40) || '…' ELSE coalesce(v, '') END, '|', '\\|'), chr(10), ' ') AS cell, sha256(CASE WHEN v IS NULL THEN '' WHEN lower(trim(v)) = 'nan' THEN '(empty)' ELSE regexp_replace(v, '^{BLANK}+|{BLANK}+$', '', 'g') END) AS shown_sha256 FROM v",
    "unit_vectors": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, CASE WHEN vec_id % 7 = 0 THEN 0.0::DOUBLE ELSE round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) END AS first FROM embeddings",
    "seeded_sample": "SELECT doc_id, lang, source FROM documents ORDER BY sha256(concat_ws(chr(31), '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 20",
    "seeds": "SELECT DISTINCT c_mktsegment AS segment, substr(sha256(concat_ws(chr(31), '7', c_mktsegment, 'struct')), 1, 16) AS seed FROM customer",
    "sample_sizes": f"WITH c AS (SELECT source, count(*) AS population FROM documents GROUP BY source) SELECT source, population, {_SIZE_SQL.format(n='population')} AS drawn, round({_SIZE_SQL.format(n='population')}::DOUBLE / population, 6) AS probability FROM c",
    "wilson_intervals": f"WITH c AS (SELECT lang, count(*) AS n, avg(toxic::DOUBLE) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, round(p, 6) AS p, round({_wilson_sql('p', 'n', '-')}, 6) AS low, round({_wilson_sql('p', 'n', '+')}, 6) AS high FROM c",
    "stratified_wilson": retrieval._sql(f"""SELECT need_id, formulation, round((n_i * p_i + n_r * CASE WHEN d >= n_r OR n_r <= 0 THEN q_r ELSE {_wilson_sql('q_r', 'd', '-')} END) / (n_i + n_r), 6) AS wilson_low, round((n_i * p_i + n_r * CASE WHEN d >= n_r OR n_r <= 0 THEN q_r ELSE {_wilson_sql('q_r', 'd', '+')} END) / (n_i + n_r), 6) AS wilson_high FROM (
  SELECT sz.need_id, sz.formulation, n_i, n_r, greatest(1, n_r // 10)::DOUBLE AS d, coalesce(p_i, 0.0::DOUBLE) AS p_i, coalesce(q_r, 0.0::DOUBLE) AS q_r FROM sz JOIN (SELECT sr.need_id, formulation, avg(relevant::INT) FILTER (WHERE stratum = 'I') AS p_i, avg(relevant::INT) FILTER (WHERE stratum = 'R') AS q_r FROM sr LEFT JOIN j ON sr.need_id = j.need_id AND sr.doc_id = j.doc_id GROUP BY ALL) x ON sz.need_id = x.need_id AND sz.formulation = x.formulation)"""),
    "ranked_set": "SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderpriority = '1-URGENT'",
    "ranked_corpus": "SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "passages": "SELECT doc_id, substr(text, 1, 500) AS passage FROM documents",
    "first_documents": f"WITH w AS (SELECT doc_id, len({SQL_WORDS}) AS n FROM documents), f AS (SELECT * FROM w WHERE n > 0 ORDER BY doc_id LIMIT 50) SELECT doc_id, CASE WHEN n <= 100 THEN 1 ELSE CAST(ceil((n - 100) / 80.0) AS BIGINT) + 1 END AS n_chunks FROM f",
    "known_references": "SELECT 'N0' AS need_id, doc_id, true AS in_corpus FROM labels UNION ALL SELECT 'N0', -doc_id - 1, false FROM labels",
    "source_counts": retrieval._sql("SELECT need_id, count(*) AS n_pairs, count(*) FILTER (WHERE is_top_vector) AS n_top_vector, count(*) FILTER (WHERE is_top_hybrid) AS n_top_hybrid, count(*) FILTER (WHERE is_strict) AS n_strict, count(*) FILTER (WHERE is_reference) AS n_reference FROM og GROUP BY need_id"),
    "broad_sets": retrieval._sql("SELECT need_id, formulation, count(*) AS n, count(*) >= 50 AS is_broad FROM st GROUP BY need_id, formulation"),
    "complement_strata": retrieval._sql("SELECT need_id, formulation, doc_id, stratum FROM sr2"),
    "recalled_by": retrieval._sql("SELECT need_id, doc_id, formulation, string_agg(architecture || ':' || rank, ',' ORDER BY CASE architecture WHEN 'vector' THEN 1 ELSE 2 END) AS recalled FROM r SEMI JOIN j0 USING (need_id, doc_id) GROUP BY need_id, doc_id, formulation"),
    "set_shares": retrieval._sql("SELECT st.need_id, formulation, count(*) AS set_size, round(count(relevant)::DOUBLE / count(*), 4) AS judged_share FROM st LEFT JOIN j ON st.need_id = j.need_id AND st.doc_id = j.doc_id GROUP BY ALL"),
}

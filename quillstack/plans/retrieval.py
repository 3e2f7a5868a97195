"""Queries of retrieval and evaluation over the test tables, and their SQL twins.

Vectors stand for chunks: document = vec_id % 100, position = vec_id. Needs are the tens of the first 30 vectors, their
formulations the first three of each ten. Sets and judgments follow from ids and labels by rules that both sides state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.evaluation import judgment, metrics, pool
from quillstack.functions import sampling, text
from quillstack.plans.corpus import BLANK, KIND_SQL, kinds, read
from quillstack.retrieval import hybrid, structured, vector

NAMES = ("direct", "paraphrase", "verbose")
DEPTH, MOST_SET, MOST_COMPLEMENT, SEED = 10, 12, 12, 7


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("doc_id"), F.col("vec_id").alias("pos"), "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "embeddings").where("vec_id < 30 and vec_id % 10 < 3")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("vec_id") % 10 + 1).cast("int"))
    return own.select(F.concat(F.lit("N"), F.floor(F.col("vec_id") / 10).cast("string")).alias("need_id"), name.alias("formulation"), F.col("embedding").alias("vector"))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vector.scored_many(chunks(spark, sf_dir), questions(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return vector.max_pool(scored, ["need_id", "formulation", "doc_id"], "score", "pos")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir).select("doc_id").distinct()
    rule = "(need_id = 'N0' and formulation <> 'paraphrase' and doc_id % 2 = 0) or (need_id = 'N1' and doc_id % 7 = 1) or (need_id = 'N2' and doc_id % 33 = 5)"
    return questions(spark, sf_dir).select("need_id", "formulation").join(docs, F.expr(rule))


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector rankings of all documents, hybrid ones of each question's set."""
    own = pooled(spark, sf_dir)
    by_vector = vector.top_k(own, ["need_id", "formulation"], 50).withColumn("architecture", F.lit("vector"))
    inside = own.join(sets(spark, sf_dir), ["need_id", "formulation", "doc_id"], "left_semi")
    by_hybrid = vector.top_k(inside, ["need_id", "formulation"], 50).withColumn("architecture", F.lit("hybrid"))
    return by_vector.unionByName(by_hybrid).select("need_id", "formulation", "architecture", "doc_id", "rank", "score")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("need_id", "formulation", F.explode(F.array(F.lit("vector"), F.lit("hybrid"))).alias("architecture"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return own.select(F.concat(F.lit("N"), F.col("n").cast("string")).alias("need_id"), "doc_id", F.expr("quality = 1 and (doc_id + n) % 3 = 0").alias("relevant"))


def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id").distinct().where("doc_id % 20 = 3").select(F.lit("N1").alias("need_id"), "doc_id")


SQL = """q AS (SELECT 'N' || (vec_id // 10) AS need_id, CASE vec_id % 10 WHEN 0 THEN 'direct' WHEN 1 THEN 'paraphrase' ELSE 'verbose' END AS formulation, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id < 30 AND vec_id % 10 < 3),
 s AS (SELECT need_id, formulation, vec_id % 100 AS doc_id, vec_id AS pos, label, round(list_dot_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q),
 p AS (SELECT need_id, formulation, doc_id, score, pos AS best_pos FROM (SELECT *, row_number() OVER (PARTITION BY need_id, formulation, doc_id ORDER BY score DESC, pos) AS n FROM s) WHERE n = 1),
 d AS (SELECT DISTINCT vec_id % 100 AS doc_id FROM embeddings),
 st AS (SELECT need_id, formulation, doc_id FROM q, d WHERE (need_id = 'N0' AND formulation <> 'paraphrase' AND doc_id % 2 = 0) OR (need_id = 'N1' AND doc_id % 7 = 1) OR (need_id = 'N2' AND doc_id % 33 = 5)),
 rk AS (SELECT need_id, formulation, 'vector' AS architecture, doc_id, row_number() OVER (PARTITION BY need_id, formulation ORDER BY score DESC, doc_id) AS rank, score FROM p
   UNION ALL SELECT need_id, formulation, 'hybrid', doc_id, row_number() OVER (PARTITION BY need_id, formulation ORDER BY score DESC, doc_id), score FROM p SEMI JOIN st USING (need_id, formulation, doc_id)),
 r AS (SELECT * FROM rk WHERE rank <= 50),
 cf AS (SELECT need_id, formulation, a AS architecture FROM q, (VALUES ('vector'), ('hybrid')) v(a)),
 j AS (SELECT 'N' || n AS need_id, doc_id, quality = 1 AND (doc_id + n) % 3 = 0 AS relevant FROM labels, range(3) t(n)),
 cm AS (SELECT 'N1' AS need_id, doc_id FROM d WHERE doc_id % 20 = 3),
 j0 AS (SELECT DISTINCT need_id, doc_id FROM (SELECT need_id, doc_id FROM r WHERE rank <= 10 UNION ALL SELECT need_id, doc_id FROM st SEMI JOIN (SELECT need_id, formulation FROM st GROUP BY ALL HAVING count(*) <= 12) x USING (need_id, formulation) UNION ALL SELECT need_id, doc_id FROM cm WHERE (SELECT count(*) FROM cm) <= 12)),
 sr AS (SELECT st.need_id, st.formulation, st.doc_id, CASE WHEN j0.doc_id IS NULL THEN 'R' ELSE 'I' END AS stratum FROM st SEMI JOIN (SELECT need_id, formulation FROM st GROUP BY ALL HAVING count(*) > 12) x ON st.need_id = x.need_id AND st.formulation = x.formulation LEFT JOIN j0 ON st.need_id = j0.need_id AND st.doc_id = j0.doc_id),
 ss AS (SELECT need_id, formulation, count(*) FILTER (WHERE stratum = 'I') AS n_i, count(*) FILTER (WHERE stratum = 'R') AS n_r FROM sr GROUP BY ALL),
 sz AS (SELECT *, CASE WHEN n_r <= 0 THEN 0 ELSE least(n_r, CAST(ceil(96.03999999999999::DOUBLE / (1.0::DOUBLE + 95.03999999999999::DOUBLE / n_r)) AS BIGINT)) END AS s_r FROM ss),
 sm AS (SELECT need_id, formulation, doc_id FROM (SELECT sr.*, s_r, row_number() OVER (PARTITION BY sr.need_id, sr.formulation ORDER BY sha256(concat_ws(chr(31), '7', sr.need_id, sr.formulation, CAST(doc_id AS VARCHAR))), doc_id) AS n FROM sr JOIN sz ON sr.need_id = sz.need_id AND sr.formulation = sz.formulation WHERE stratum = 'R') WHERE n <= s_r),
 og AS (SELECT need_id, doc_id, bool_or(v) AS is_top_vector, bool_or(h) AS is_top_hybrid, bool_or(u) AS is_strict, bool_or(e) AS is_reference, list_sort(list_distinct(list(f) FILTER (WHERE f IS NOT NULL))) AS formulations FROM (
   SELECT need_id, doc_id, formulation AS f, architecture = 'vector' AS v, architecture = 'hybrid' AS h, false AS u, false AS e FROM r WHERE rank <= 5
   UNION ALL SELECT 'N2', doc_id, NULL, false, false, true, false FROM d WHERE doc_id % 25 = 4
   UNION ALL SELECT need_id, doc_id, NULL, false, false, false, true FROM cm) GROUP BY ALL),
 pc AS (SELECT cf.need_id, cf.formulation, cf.architecture, coalesce(n, 0) AS returned, coalesce(k, 0) AS n_relevant, coalesce(a, true) AS all_judged, 5 - coalesce(n, 0) AS missing_positions, round(coalesce(k, 0) / 5.0::DOUBLE, 4) AS precision
   FROM cf LEFT JOIN (SELECT r.need_id, r.formulation, r.architecture, count(*) AS n, count(*) FILTER (WHERE relevant) AS k, bool_and(relevant IS NOT NULL) AS a FROM r LEFT JOIN j ON r.need_id = j.need_id AND r.doc_id = j.doc_id WHERE rank <= 5 GROUP BY ALL) t ON cf.need_id = t.need_id AND cf.formulation = t.formulation AND cf.architecture = t.architecture),
 kn AS (SELECT need_id, count(DISTINCT doc_id) AS n_known FROM j WHERE relevant GROUP BY need_id),
 j3 AS (SELECT DISTINCT need_id, doc_id FROM (SELECT need_id, doc_id FROM r WHERE rank <= 10 UNION ALL SELECT need_id, doc_id FROM st SEMI JOIN (SELECT need_id, formulation FROM st GROUP BY ALL HAVING count(*) <= 12) x USING (need_id, formulation))),
 s3 AS (SELECT need_id, formulation, doc_id FROM st SEMI JOIN (SELECT need_id, formulation FROM st GROUP BY ALL HAVING count(*) > 12) x USING (need_id, formulation) UNION ALL SELECT need_id, 'conditions', doc_id FROM cm),
 sr2 AS (SELECT s3.need_id, s3.formulation, s3.doc_id, CASE WHEN j3.doc_id IS NULL THEN 'R' ELSE 'I' END AS stratum FROM s3 LEFT JOIN j3 ON s3.need_id = j3.need_id AND s3.doc_id = j3.doc_id)"""


def _sql(tail: str) -> str:
    """The tail with just the steps it needs, in order."""
    import re

    steps = re.split(r",\n (?=\w+ AS \()", SQL)
    named = {s.split(" AS (", 1)[0].strip(): s for s in steps}
    needed: set[str] = set()

    def need(body: str) -> None:
        for name in named:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b|,\s{name}\b", body):
                needed.add(name)
                need(named[name].split(" AS (", 1)[1])

    need(tail)
    return "WITH " + ",\n ".join(s for n, s in named.items() if n in needed) + " " + tail if needed else tail


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(pooled(spark, sf_dir).where("need_id = 'N0' and formulation = 'direct'").select("doc_id", "score", "best_pos"), [], 10)


def max_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir)


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(spark, sf_dir).where("rank <= 5")


def structured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions' conditions against orders and their customers; the third has none."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority", "c_mktsegment")
    conditions = spark.createDataFrame([("a", "o_orderpriority", "1-URGENT"), ("a", "c_mktsegment", "BUILDING"), ("b", "o_orderstatus", "P")], "query_id string, field string, value string")
    return structured.conditions_filter(orders, conditions, ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


def hybrid_filtered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(spark, sf_dir).where("architecture = 'hybrid' and rank <= 20")


def hybrid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N0 without conditions, N1 with some that match, N2 with one that nothing meets."""
    scores = pooled(spark, sf_dir).where("formulation = 'direct'").select(F.col("need_id").alias("query_id"), "doc_id", "score")
    conditions = spark.createDataFrame([("N1", 1), ("N2", 1)], "query_id string, n int")
    candidates = sets(spark, sf_dir).where("need_id = 'N1' and formulation = 'direct'").select(F.col("need_id").alias("query_id"), "doc_id")
    out = hybrid.paths(scores, conditions, candidates, scores.select("query_id").distinct())
    return vector.top_k(out, ["query_id"], 10)


def integrity_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.missing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all labels and as many invented ids."""
    own = read(spark, sf_dir, "labels").select("doc_id")
    return hybrid.difference(read(spark, sf_dir, "documents"), own.union(own.select(-F.col("doc_id") - 1)))


def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.context_tokens(structured.component_table(read(spark, sf_dir, "documents"), "text")).select("token", "df")


#: Invented institutions: variants with and without acronyms, several in a field, labels with numbers, plain words.
ENTITIES = ["Conselho Fictício de Pesquisa (CFP)", "Conselho Fictício de Pesquisa (CFP).", "CONSELHO FICTÍCIO DE PESQUISA", "Serviço Modelo de Aprendizagem (Sma/XX, CNPJ 01.234)", "Agência Exemplar de Transporte (AET); Fundação Imaginária (em Liquidação)", "Fundo Ilustrativo (AET)", "Estado de Alfa", "Instituto Ensaio de Águas (IEA)"]
QUESTIONS = ["decisões sobre o Conselho Ficticio de Pesquisa", "o que decidiu a cfp em 2024", "transporte: AET", "casos da Sma/XX e da IEA", "Fundação Imaginária (em Liquidação)", "nada a ver"]


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invented institutions and the kinds of all parts."""
    own = spark.createDataFrame([(e,) for e in ENTITIES], "entity string").union(kinds(spark, sf_dir).select("kind"))
    return structured.component_table(own, "entity")


def acronym_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.acronym_dictionary(_entities(spark, sf_dir)).select("acronym", "n_identities", "component")


def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invented questions and one on each part, which names its kind by its acronym."""
    own = kinds(spark, sf_dir).select((F.col("p_partkey") + 100).alias("query_id"), F.concat(F.lit("casos de "), text.name_and_acronym("kind")[1]).alias("query"))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string").union(own)
    q = asked.select("query_id", text.fold_query("query").alias("folded_query"))
    none = F.array().cast("array<string>")
    by_acronym = structured.match_acronym(q, structured.acronym_dictionary(_entities(spark, sf_dir)))
    by_name = structured.match_name(q, _entities(spark, sf_dir), none, ()).where("n_identities = 1").select("query_id", "value")
    return by_acronym.withColumn("matched_by", F.lit("acronym")).union(by_name.join(by_acronym, "query_id", "left_anti").withColumn("matched_by", F.lit("name")))


def strict_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("kind", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'REPRESENTAÇÃO (REPR)' WHEN doc_id % 3 = 1 THEN 'Repr.' ELSE 'Reprise' END"))
    return judgment.strict_universe(docs, [("text", ["thereof then"], ["the", "eiñe", "éon"]), ("kind", ["representacao"], ["repr"])])


CONDITIONS = [{"relates_to": "metadata", "fields": ["lang_name"], "description": "Língua: Français ou english"}, {"relates_to": "metadata", "fields": ["source"], "description": "src1-origem src11"}, {"relates_to": "textual", "fields": [], "description": "ignored"}]


def condition_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("lang_name", F.expr("CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'FRANÇAIS' WHEN 'de' THEN NULL ELSE 'Español' END"))
    return pool.condition_complement(docs, CONDITIONS)


def pool_j0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.union_of(rankings(spark, sf_dir), sets(spark, sf_dir), complement(spark, sf_dir), DEPTH, MOST_SET, MOST_COMPLEMENT)


def stratum_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.strata(sets(spark, sf_dir), pool_j0(spark, sf_dir), MOST_SET)


def pool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j0 = pool_j0(spark, sf_dir)
    return pool.pool(j0, pool.stratum_sample(pool.strata(sets(spark, sf_dir), j0, MOST_SET), SEED))


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = chunks(spark, sf_dir).select("doc_id").distinct().where("doc_id % 25 = 4").select(F.lit("N2").alias("need_id"), "doc_id")
    return judgment.sources(rankings(spark, sf_dir).where("rank <= 5"), universe, complement(spark, sf_dir))


def judgment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origins(spark, sf_dir).withColumn("formulations", F.array_join("formulations", ","))


def judgment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgment.overlaps(_origins(spark, sf_dir))


def pair_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgment.repeated_pairs(rankings(spark, sf_dir).where("rank <= 5"), ["need_id", "doc_id"])


def blind_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgment.batches(_origins(spark, sf_dir))


def pairs_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs and as many with invented ids beside the whole corpus."""
    own = _origins(spark, sf_dir).select("need_id", "doc_id")
    pairs = own.union(own.select("need_id", -F.col("doc_id") - 1))
    return judgment.with_documents(pairs, read(spark, sf_dir, "documents"), ["lang", "text"], 80).drop("lang__length")


def _precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_at(configs(spark, sf_dir), rankings(spark, sf_dir), judgments(spark, sf_dir))


def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _precision(spark, sf_dir)


def precision_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_means(_precision(spark, sf_dir), ["need_id", "architecture"])


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_difference(_precision(spark, sf_dir))


def relevant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relevant_coverage(configs(spark, sf_dir), rankings(spark, sf_dir), judgments(spark, sf_dir))


def structured_set_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.set_analysis(sets(spark, sf_dir), judgments(spark, sf_dir), 100)


def stratified_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each large set's share of relevant documents, with unjudged members of a stratum left out of its share."""
    split = stratum_split(spark, sf_dir)
    known = split.join(judgments(spark, sf_dir), ["need_id", "doc_id"], "left")
    of = lambda s: F.coalesce(F.avg(F.when((F.col("stratum") == s) & F.col("relevant").isNotNull(), F.col("relevant").cast("double"))), F.lit(0.0))
    shares = known.groupBy("need_id", "formulation").agg(of("I").alias("p_i"), of("R").alias("q_r"))
    own = pool.stratum_sizes(split).join(shares, ["need_id", "formulation"])
    found = sampling.stratified_estimate(F.col("n_i"), F.col("p_i"), F.col("n_r"), F.col("s_r"), F.col("q_r"))
    return own.select("need_id", "formulation", "n_i", "n_r", "s_r", *(F.round(c, 6).alias(n) for n, c in found.items()))


def recall_under_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_under_pool(configs(spark, sf_dir), rankings(spark, sf_dir), judgments(spark, sf_dir), [5, 10, 50])


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_metrics(configs(spark, sf_dir), rankings(spark, sf_dir), judgments(spark, sf_dir))


_ALL = (vector_topk, max_pooling, topk_per_group, structured_filter, hybrid_filtered_rank, hybrid_paths, integrity_missing, integrity_diff, context_tokens, acronym_dictionary, dictionary_match, strict_universe, condition_complement, pool_j0, stratum_split, pool_candidates, judgment_sources, judgment_overlaps, pair_uniqueness, blind_batches, pairs_left_join, precision_at_5, precision_means, paired_diff, relevant_coverage, structured_set_analysis, stratified_estimate, recall_under_pool, mrr)
QUERIES = {f.__name__: f for f in _ALL}


def _folded(v: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(translate({v}, 'ªº°', 'aoo'))), '{BLANK}+', ' ', 'g'))"


_VALUES = ", ".join("('" + e.replace("'", "''") + "')" for e in ENTITIES)
_PARTS = f"""v AS (SELECT * FROM (VALUES {_VALUES}) t(entity) UNION ALL SELECT {KIND_SQL} FROM part),
 c AS (SELECT DISTINCT trim(regexp_replace(trim(x), '\\.+$', '')) AS component FROM v, unnest(string_split(entity, ';')) u(x)),
 pt AS (SELECT component, regexp_replace({_folded('component')}, '[. ]+$', '') AS folded, regexp_replace(trim(regexp_replace(regexp_replace({_folded('component')}, '\\([^)]*\\)', ' ', 'g'), '{BLANK}+', ' ', 'g')), '[. ]+$', '') AS identity FROM c WHERE component <> ''),
 g AS (SELECT component, identity, unnest(regexp_extract_all(component, '\\(([^)]+)\\)', 1)) AS grp FROM pt),
 tk AS (SELECT component, identity, string_split_regex(trim(x), '{BLANK}+') AS a FROM g, unnest(string_split_regex(grp, '[,;]')) u(x)),
 t1 AS (SELECT component, identity, regexp_replace(a[1], '^\\.+|\\.+$', '', 'g') AS t FROM tk WHERE NOT coalesce(regexp_matches(a[2], '^[0-9]'), false)),
 ac AS (SELECT DISTINCT {_folded('t')} AS acronym, component, identity FROM t1 WHERE length(t) BETWEEN 2 AND 12 AND regexp_full_match(t, '[A-Za-zºª]+([/.\\-][A-Za-z0-9ºª]+)*')
   AND (contains(t, '/') OR length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) >= 2 OR length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) = length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')))),
 ad AS (SELECT acronym, count(DISTINCT identity) AS n_identities, arg_min(component, (length(component), component)) AS component FROM ac GROUP BY acronym)"""
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))

ORACLES = {
    "vector_topk": _sql("SELECT doc_id, score, best_pos, rank FROM (SELECT doc_id, score, best_pos, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM p WHERE need_id = 'N0' AND formulation = 'direct') WHERE rank <= 10"),
    "max_pooling": _sql("SELECT need_id, formulation, doc_id, score, best_pos FROM p"),
    "topk_per_group": _sql("SELECT need_id, formulation, architecture, doc_id, CAST(rank AS INT) AS rank, score FROM r WHERE rank <= 5"),
    "structured_filter": "WITH o AS (SELECT o_orderkey AS doc_id, * FROM orders JOIN customer ON o_custkey = c_custkey) SELECT 'a' AS query_id, doc_id FROM o WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'b', doc_id FROM o WHERE o_orderstatus = 'P'",
    "hybrid_filtered_rank": _sql("SELECT need_id, formulation, architecture, doc_id, CAST(rank AS INT) AS rank, score FROM r WHERE architecture = 'hybrid' AND rank <= 20"),
    "hybrid_paths": _sql("SELECT * FROM (SELECT need_id AS query_id, doc_id, score, CASE WHEN need_id = 'N0' THEN 'A' ELSE 'C' END AS path, CAST(row_number() OVER (PARTITION BY need_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM p WHERE formulation = 'direct' AND (need_id = 'N0' OR (need_id = 'N1' AND doc_id % 7 = 1))) WHERE rank <= 10"),
    "integrity_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "integrity_diff": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels UNION SELECT -doc_id - 1 FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "context_tokens": f"""WITH c AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g'), '\\.+$', ''), '^{BLANK}+|{BLANK}+$', '', 'g') AS component FROM documents, unnest(string_split(text, ';')) u(x)),
 n AS (SELECT count(*) AS n FROM c WHERE component <> ''), t AS (SELECT DISTINCT component, unnest(string_split({_folded('component')}, ' ')) AS token FROM c WHERE component <> '')
 SELECT token, count(*) AS df FROM t, n WHERE length(token) >= 4 GROUP BY token, n HAVING count(*) >= 0.02::DOUBLE * n AND n >= 200""",
    "acronym_dictionary": f"WITH {_PARTS} SELECT acronym, n_identities, component FROM ad",
    "dictionary_match": f"""WITH {_PARTS}, qs AS (SELECT query_id, {_folded('query')} AS fq FROM (SELECT * FROM (VALUES {_ASKED}) t(query_id, query) UNION ALL SELECT p_partkey + 100, 'casos de ' || regexp_extract({KIND_SQL}, '\\((.*)\\)', 1) FROM part)),
 ha AS (SELECT query_id, component AS value, row_number() OVER (PARTITION BY query_id ORDER BY length(acronym) DESC, acronym) AS n FROM qs, ad WHERE n_identities = 1 AND (contains(acronym, '/') OR length(acronym) >= 3) AND regexp_matches(fq, '(^|[^\\w/])' || regexp_escape(acronym) || '([^\\w/]|$)')),
 hn AS (SELECT query_id, arg_min(component, (length(component), component)) AS value FROM qs, pt WHERE length(folded) >= 12 AND len(list_filter(string_split(folded, ' '), lambda t: length(t) >= 4)) > 0 AND contains(fq, folded) GROUP BY query_id HAVING count(DISTINCT identity) = 1)
 SELECT query_id, value, 'acronym' AS matched_by FROM ha WHERE n = 1 UNION ALL SELECT query_id, value, 'name' FROM hn WHERE query_id NOT IN (SELECT query_id FROM ha)""",
    "strict_universe": f"""WITH t AS (SELECT doc_id, {_folded('text')} AS x, doc_id % 3 AS k FROM documents) SELECT doc_id FROM t WHERE k <> 2 AND (contains(x, 'thereof then') OR regexp_matches(x, '(^|[^0-9A-Za-z_])(the|éon)([^0-9A-Za-z_]|$)'))""",
    "condition_complement": "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND contains(source, 'src1')",
    "pool_j0": _sql("SELECT need_id, doc_id FROM j0"),
    "stratum_split": _sql("SELECT need_id, formulation, doc_id, stratum FROM sr"),
    "pool_candidates": _sql("SELECT need_id, doc_id, bool_or(a) AS in_j0, bool_or(b) AS in_sample FROM (SELECT need_id, doc_id, true AS a, false AS b FROM j0 UNION ALL SELECT need_id, doc_id, false, true FROM sm) GROUP BY need_id, doc_id"),
    "judgment_sources": _sql("SELECT need_id, doc_id, is_top_vector, is_top_hybrid, is_strict, is_reference, coalesce(array_to_string(formulations, ','), '') AS formulations FROM og"),
    "judgment_overlaps": _sql("SELECT count(*) FILTER (WHERE is_top_vector AND is_top_hybrid) AS n_vector_hybrid, count(*) FILTER (WHERE (is_top_vector OR is_top_hybrid) AND is_strict) AS n_top_strict, count(*) FILTER (WHERE (is_top_vector OR is_top_hybrid) AND is_reference) AS n_top_reference, count(*) FILTER (WHERE is_strict AND is_reference) AS n_strict_reference FROM og"),
    "pair_uniqueness": _sql("SELECT need_id, doc_id, count(*) AS n FROM r WHERE rank <= 5 GROUP BY need_id, doc_id HAVING count(*) > 1"),
    "blind_batches": _sql("SELECT need_id, doc_id, CAST(row_number() OVER (PARTITION BY need_id ORDER BY doc_id) AS INT) AS turn, CAST(ceil(row_number() OVER (PARTITION BY need_id ORDER BY doc_id) / 5.0) AS INT) AS batch FROM (SELECT DISTINCT need_id, doc_id FROM og)"),
    "pairs_left_join": _sql(f"SELECT p.need_id, p.doc_id, CASE WHEN x.doc_id IS NULL THEN '(outside the selection)' ELSE x.lang END AS lang, CASE WHEN x.doc_id IS NULL THEN '(outside the selection)' ELSE substr(x.t, 1, 80) END AS text, CAST(length(x.t) AS INT) AS text__length FROM (SELECT need_id, doc_id FROM og UNION ALL SELECT need_id, -doc_id - 1 FROM og) p LEFT JOIN (SELECT doc_id, lang, regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM documents) x ON p.doc_id = x.doc_id"),
    "precision_at_5": _sql("SELECT * FROM pc"),
    "precision_means": _sql("SELECT need_id, architecture, round(avg(precision), 4) AS mean_precision, count(*) AS n_configs FROM pc GROUP BY need_id, architecture"),
    "paired_diff": _sql("SELECT need_id, formulation, max(precision) FILTER (WHERE architecture = 'hybrid') AS hybrid, max(precision) FILTER (WHERE architecture = 'vector') AS vector, round(max(precision) FILTER (WHERE architecture = 'hybrid') - max(precision) FILTER (WHERE architecture = 'vector'), 4) AS difference FROM pc GROUP BY need_id, formulation"),
    "relevant_coverage": _sql("SELECT cf.need_id, cf.formulation, cf.architecture, coalesce(n_known, 0) AS n_known, coalesce(n, 0) AS n_found, CASE WHEN n_known > 0 THEN round(coalesce(n, 0)::DOUBLE / n_known, 4) END AS coverage FROM cf LEFT JOIN kn ON cf.need_id = kn.need_id LEFT JOIN (SELECT r.need_id, formulation, architecture, count(DISTINCT r.doc_id) AS n FROM r JOIN j ON r.need_id = j.need_id AND r.doc_id = j.doc_id WHERE relevant GROUP BY ALL) f ON cf.need_id = f.need_id AND cf.formulation = f.formulation AND cf.architecture = f.architecture"),
    "structured_set_analysis": _sql("SELECT st.need_id, formulation, count(*) AS set_size, count(relevant) AS n_judged, count(*) FILTER (WHERE relevant) AS n_relevant, count(*) FILTER (WHERE NOT relevant) AS n_irrelevant, count(*) - count(relevant) AS n_unjudged, round(count(relevant)::DOUBLE / count(*), 4) AS judged_share, count(*) >= 50 AS is_broad FROM st LEFT JOIN j ON st.need_id = j.need_id AND st.doc_id = j.doc_id GROUP BY ALL"),
    "stratified_estimate": _sql("""SELECT need_id, formulation, n_i, n_r, s_r, round(p, 6) AS p_hat, round(v, 6) AS variance, round(greatest(0.0, p - 1.96 * sqrt(v)), 6) AS low, round(least(1.0, p + 1.96 * sqrt(v)), 6) AS high FROM (
 SELECT *, CASE WHEN n_i + n_r > 0 THEN (n_i * p_i + n_r * q_r) / (n_i + n_r) ELSE 0.0 END AS p, CASE WHEN n_i + n_r > 0 THEN pow(n_r::DOUBLE / (n_i + n_r), 2) * CASE WHEN s_r > 0 AND n_r > 1 THEN q_r * (1 - q_r) / s_r * (n_r - s_r) / (n_r - 1) ELSE 0.0 END ELSE 0.0 END AS v FROM (
  SELECT sz.need_id, sz.formulation, n_i, n_r, s_r, coalesce(p_i, 0.0::DOUBLE) AS p_i, coalesce(q_r, 0.0::DOUBLE) AS q_r FROM sz JOIN (SELECT sr.need_id, formulation, avg(relevant::INT) FILTER (WHERE stratum = 'I') AS p_i, avg(relevant::INT) FILTER (WHERE stratum = 'R') AS q_r FROM sr LEFT JOIN j ON sr.need_id = j.need_id AND sr.doc_id = j.doc_id GROUP BY ALL) x ON sz.need_id = x.need_id AND sz.formulation = x.formulation))"""),
    "recall_under_pool": _sql("SELECT cf.need_id, cf.formulation, cf.architecture, CAST(k AS INT) AS k, CASE WHEN n_known > 0 THEN round((SELECT count(DISTINCT r.doc_id) FROM r JOIN j ON r.need_id = j.need_id AND r.doc_id = j.doc_id WHERE relevant AND rank <= k AND r.need_id = cf.need_id AND r.formulation = cf.formulation AND r.architecture = cf.architecture)::DOUBLE / n_known, 4) END AS recall FROM cf CROSS JOIN (VALUES (5), (10), (50)) t(k) LEFT JOIN kn ON cf.need_id = kn.need_id"),
    "mrr": _sql("""SELECT cf.need_id, cf.formulation, cf.architecture, CASE WHEN n_known > 0 THEN round(coalesce(rr, 0.0::DOUBLE), 4) END AS mrr, CASE WHEN n_known > 0 THEN round(coalesce(ap, 0.0::DOUBLE) / least(n_known, 10), 4) END AS ap, CASE WHEN n_known > 0 THEN round(coalesce(dcg, 0.0::DOUBLE) / list_sum(list_transform(range(1, least(n_known, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 4) END AS ndcg
 FROM cf LEFT JOIN kn ON cf.need_id = kn.need_id LEFT JOIN (SELECT need_id, formulation, architecture, max(1.0::DOUBLE / rank) FILTER (WHERE hit) AS rr, sum(so_far::DOUBLE / rank) FILTER (WHERE hit) AS ap, sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE hit) AS dcg FROM (
  SELECT r.need_id, formulation, architecture, rank, coalesce(relevant, false) AS hit, sum(coalesce(relevant, false)::INT) OVER (PARTITION BY r.need_id, formulation, architecture ORDER BY rank) AS so_far FROM r LEFT JOIN j ON r.need_id = j.need_id AND r.doc_id = j.doc_id WHERE rank <= 10) GROUP BY ALL) x ON cf.need_id = x.need_id AND cf.formulation = x.formulation AND cf.architecture = x.architecture"""),
}

"""Queries of the corpus operators (audit, canonicalisation, eligibility, profiles, text) and their SQL twins.

The test tables have no blanks, placeholders or repeated keys, so inputs derive them with the same CASE on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import hashing, text
from quillstack.operators import audit, canon, chunks, eligibility, profile
from quillstack.sources.config import CorpusConfig, Eligibility, Placeholder
from quillstack.sources.manifest import first_match

BLANK = text.BLANK
SQL_WORDS = f"list_filter(string_split_regex(text, '{BLANK}+'), lambda t: t <> '')"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents whose source is null, blank or dotted in some rows."""
    return read(spark, sf_dir, "documents").withColumn("source", F.expr(HOLES))


HOLES = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN concat(source, '..') WHEN doc_id % 17 = 0 THEN concat(' ', source, '; ', lang, ' ') ELSE source END"


#: A part's type with an invented acronym.
KIND = "concat(p_type, ' (', upper(translate(substr({hash}, 1, 4), '0123456789', 'ghijklmnop')), ')')"
KIND_SQL = "p_type || ' (' || upper(translate(substr(sha256(p_type), 1, 4), '0123456789', 'ghijklmnop')) || ')'"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.expr(KIND.format(hash="sha2(p_type, 256)")).alias("kind"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.column_profile(holed(spark, sf_dir).select("doc_id", "text", "lang", "source"))


def _profile_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"SELECT '{c}' AS column_name, count(*) AS n_total, count(*) FILTER (WHERE {v} IS NULL OR regexp_full_match({v}, '{BLANK}*')) AS n_missing, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE {v} IS NULL OR regexp_full_match({v}, '{BLANK}*'))) / count(*), 2) END AS coverage_pct, count(DISTINCT {v}) AS n_distinct FROM h"


HOLED_SQL = f"WITH h AS (SELECT * REPLACE ({HOLES} AS source) FROM documents)"


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k")), "k")


def text_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.text_lengths(read(spark, sf_dir, "documents"), "text", ["lang"])


def docs_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.without_text(holed(spark, sf_dir), "source", "doc_id")


CONFIG = CorpusConfig(allowed_fields=["text", "lang", "source", "key"], primary_key_field="key", required_fields=["source"], retrieval_text_fields=["text"], metadata_fields=["lang", "source"], preserved_fields=["source", "note"][:1])


def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("key", F.col("doc_id").cast("string")).withColumn("source_key", F.col("key")).withColumn("doc_id", hashing.document_id("key"))
    return canon.project(docs, ["doc_id", "source_key", *CONFIG.canonical_columns(), "absent"])


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by a short hash of their text, so keys repeat; some are blank."""
    return holed(spark, sf_dir).withColumn("key", F.expr("CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE substring(sha2(text, 256), 1, 3) END")).withColumn("row_index", F.col("doc_id"))


def canon_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonicalise(keyed(spark, sf_dir), CONFIG).rejected


def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 2).alias("short_id"), F.col("doc_id").cast("string").alias("key"))
    return canon.collisions(docs, "short_id", "key")


POLICY = Eligibility(required_text_fields=["html", "url"], forbidden_exact_values={"url": ["https://example.com/none"]}, placeholder=Placeholder(field="html", patterns=["<b>Withheld</b>  page", ""]))
PAGES = "CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 10 = 1 THEN '<p> </p>' WHEN page_id % 10 = 2 THEN concat('<div>Withheld</div> page ', html) ELSE html END"
URLS = "CASE WHEN page_id % 15 = 0 THEN 'https://example.com/none' WHEN page_id % 15 = 1 THEN '\t' ELSE url END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.expr(PAGES).alias("html"), F.expr(URLS).alias("url"))


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.select(pages(spark, sf_dir), POLICY)[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = eligibility.evaluate(pages(spark, sf_dir), POLICY)
    return own.agg(F.count("*").alias("n_total"), F.count_if(F.size("reasons") == 0).alias("n_eligible"), F.count_if(F.size("reasons") > 0).alias("n_ineligible"))


def _plain(v: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({v}, ''), '<[^>]+>', ' ', 'g'), '{BLANK}+', ' ', 'g'))"


REASONS_SQL = f"""WITH p AS (SELECT page_id AS doc_id, {PAGES} AS html, {URLS.replace(chr(9), "' || chr(9) || '")} AS url FROM pages),
 n AS (SELECT *, {_plain('html')} AS h, {_plain('url')} AS u FROM p),
 r AS (SELECT doc_id, concat_ws(',', CASE WHEN h = '' THEN 'html_null_or_empty' END, CASE WHEN h <> '' AND starts_with(h, 'Withheld page') THEN 'html_placeholder' END, CASE WHEN u = '' THEN 'url_null_or_empty' END, CASE WHEN url = 'https://example.com/none' THEN 'url_forbidden_value' END) AS reasons FROM n)"""


def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_profile(holed(spark, sf_dir), ["lang", "source"])


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(read(spark, sf_dir, "part"), "p_type")


def rare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rare_values(read(spark, sf_dir, "pages"), "url")


def _fold(v: str) -> str:
    return f"replace(lower(regexp_replace(trim(regexp_replace({v}, '{BLANK}+', ' ', 'g')), '\\.+$', '')), 'ß', 'ss')"


def _field_sql(c: str) -> str:
    there = f"{c} IS NOT NULL AND NOT regexp_full_match({c}, '{BLANK}*')"
    bare = f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
    return f"""SELECT '{c}' AS field, count(*) AS n_total, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) FILTER (WHERE {c} IS NOT NULL AND regexp_full_match({c}, '{BLANK}*')) AS n_empty, count(*) FILTER (WHERE {there}) AS n_present,
 count(*) FILTER (WHERE {c} <> {bare}) AS n_edge_space, count(*) FILTER (WHERE {there} AND ends_with({bare}, '.')) AS n_trailing_dot, count(*) FILTER (WHERE {there} AND contains({bare}, ';')) AS n_multivalue, count(DISTINCT CASE WHEN {there} THEN {c} END) AS n_distinct_raw, count(DISTINCT CASE WHEN {there} THEN {_fold(c)} END) AS n_distinct_folded FROM h"""


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows and columns of orders; prices as exact decimals, since engines write doubles differently."""
    orders = read(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    return hashing.table_hash(orders.select(hashing.row_hash(orders).alias("h")))


def _tagged(c: str, tag: str) -> str:
    return f"coalesce(length('{tag}:' || CAST({c} AS VARCHAR))::VARCHAR || ':{tag}:' || CAST({c} AS VARCHAR), 'n')"


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.clean_html("html").alias("plain"))


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.documents_to_chunks(read(spark, sf_dir, "documents"), "doc_id", ["text"], html=False).select("doc_id", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


CHUNKS_SQL = f"""WITH w AS (SELECT doc_id, {SQL_WORDS} AS a FROM documents),
 k AS (SELECT doc_id, a, CASE WHEN len(a) <= 100 THEN 0 ELSE CAST(ceil((len(a) - 100) / 80.0) AS INT) END AS k FROM w WHERE len(a) > 0),
 c AS (SELECT doc_id, unnest(range(k + 1)) AS i, a FROM k),
 x AS (SELECT doc_id, i, array_to_string(a[i * 80 + 1 : i * 80 + 100], ' ') AS t, len(a[i * 80 + 1 : i * 80 + 100]) AS n FROM c)"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.documents_to_chunks(read(spark, sf_dir, "documents"), "doc_id", ["text"], html=False)
    n = F.size(text.words("text"))
    return out.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.min(n).cast("long").alias("min_words"), F.max(n).cast("long").alias("max_words"), F.round(F.avg(n), 4).alias("mean_words"))


def shard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.documents_to_chunks(read(spark, sf_dir, "documents"), "doc_id", ["text"], html=False)
    return chunks.shard_bounds(chunks.positioned(out.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"]), "pos", 2000)


def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return first_match(docs, docs.select("sha256", F.col("doc_id").alias("first_id")), "sha256", "first_id")


def predicate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return audit.predicate_counts(orders, {"is_urgent": F.col("o_orderpriority") == "1-URGENT", "is_building": F.col("c_mktsegment") == "BUILDING", "is_open": F.col("o_orderstatus") == "O"})


QUERIES = {f.__name__: f for f in (column_profile, duplicate_keys, text_length_profile, docs_without_text, canonical_projection, canon_rejects, id_collisions, eligibility_reasons, eligibility_counts, field_profile, top_values, rare_values, dataset_fingerprint, clean_html, chunk_words, chunk_stats, shard_bounds, manifest_lookup, predicate_grid)}

ORACLES = {
    "column_profile": f"{HOLED_SQL} " + " UNION ALL ".join(map(_profile_sql, ("doc_id", "text", "lang", "source"))),
    "duplicate_keys": "WITH k AS (SELECT sha256(text) AS k FROM documents) SELECT count(k) AS n_rows, count(DISTINCT k) AS n_keys, count(k) - count(DISTINCT k) AS n_duplicates FROM k",
    "text_length_profile": "SELECT lang, count(length(text)) AS n_texts, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, round(avg(length(text)), 2) AS mean_len, round(quantile_cont(length(text), 0.5), 2) AS median_len, round(quantile_cont(length(text), 0.25), 2) AS p25_len, round(quantile_cont(length(text), 0.75), 2) AS p75_len FROM documents GROUP BY lang",
    "docs_without_text": f"{HOLED_SQL} SELECT doc_id AS row_index FROM h WHERE source IS NULL OR regexp_full_match(source, '{BLANK}*')",
    "canonical_projection": "SELECT 'doc-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS doc_id, CAST(doc_id AS VARCHAR) AS source_key, text, lang, source, CAST(NULL AS VARCHAR) AS absent FROM documents",
    "canon_rejects": f"""{HOLED_SQL}, k AS (SELECT doc_id, source, CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE substr(sha256(text), 1, 3) END AS key FROM h),
 r AS (SELECT *, CASE WHEN key = ' ' THEN 'source_key_null_or_empty' WHEN source IS NULL OR regexp_full_match(source, '{BLANK}*') THEN 'required_field_missing:source' END AS reason FROM k),
 t AS (SELECT *, row_number() OVER (PARTITION BY key, reason IS NULL ORDER BY doc_id) AS n FROM r),
 f AS (SELECT key, doc_id, coalesce(reason, CASE WHEN n > 1 THEN 'duplicate_source_key' END) AS reason FROM t)
 SELECT CASE WHEN reason <> 'source_key_null_or_empty' THEN key END AS source_key, doc_id AS row_index, reason FROM f WHERE reason IS NOT NULL""",
    "id_collisions": "SELECT substr(sha256(text), 1, 2) AS doc_id, count(DISTINCT doc_id) AS n_keys FROM documents GROUP BY substr(sha256(text), 1, 2) HAVING count(DISTINCT documents.doc_id) > 1",
    "eligibility_reasons": f"{REASONS_SQL} SELECT doc_id, reasons FROM r WHERE reasons <> ''",
    "eligibility_counts": f"{REASONS_SQL} SELECT count(*) AS n_total, count(*) FILTER (WHERE reasons = '') AS n_eligible, count(*) FILTER (WHERE reasons <> '') AS n_ineligible FROM r",
    "field_profile": f"{HOLED_SQL} {_field_sql('lang')} UNION ALL {_field_sql('source')}",
    "top_values": "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 15",
    "rare_values": "WITH c AS (SELECT url AS value, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT * FROM c WHERE n <= 1) SELECT value, n, (SELECT count(*) FROM r) AS n_rare FROM r ORDER BY value LIMIT 20",
    "dataset_fingerprint": f"""WITH r AS (SELECT sha256(concat_ws(chr(31), {_tagged('o_custkey', 'i')}, {_tagged("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", 't')}, {_tagged('o_orderkey', 'i')}, {_tagged('o_orderpriority', 's')}, {_tagged('o_orderstatus', 's')}, {_tagged('CAST(o_totalprice AS DECIMAL(15, 2))', 'i')})) AS h FROM orders)
 SELECT sha256(concat_ws(':', count(*), {', '.join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)), 0)" for k in range(4))})) AS fingerprint FROM r""",
    "clean_html": f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(CASE WHEN html IS NULL OR lower(regexp_replace(html, '^{BLANK}+|{BLANK}+$', '', 'g')) = 'nan' THEN '' ELSE html END, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '{BLANK}+', ' ', 'g')) AS plain FROM pages""",
    "chunk_words": f"{CHUNKS_SQL} SELECT doc_id, CAST(i AS INT) AS chunk_index, sha256(t) AS text_sha256 FROM x",
    "chunk_stats": f"{CHUNKS_SQL} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, min(n) AS min_words, max(n) AS max_words, round(avg(n), 4) AS mean_words FROM x",
    "shard_bounds": f"{CHUNKS_SQL}, p AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM x) SELECT pos // 2000 AS shard_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM p GROUP BY pos // 2000",
    "manifest_lookup": "WITH d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), f AS (SELECT sha256, min(doc_id) AS first_id FROM d GROUP BY sha256) SELECT sha256, doc_id, first_id FROM d JOIN f USING (sha256)",
    "predicate_grid": "SELECT is_urgent, is_building, is_open, count(*) AS n FROM (SELECT o_orderpriority = '1-URGENT' AS is_urgent, c_mktsegment = 'BUILDING' AS is_building, o_orderstatus = 'O' AS is_open FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY CUBE (is_urgent, is_building, is_open)",
}

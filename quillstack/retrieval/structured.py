"""Structured retrieval: questions become conditions on metadata through dictionaries built from the corpus.

Interpretation is itself a DataFrame operation: a batch of questions meets the dictionaries in theta joins, and windows
choose among the hits. Conditions are rows (query_id, field, value).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.text import all_acronyms, base_identity, components, fold_query, is_blank, mentions, name_and_acronym, quoted, stem, strip, usable_acronym
from quillstack.operators.chunks import positioned
from quillstack.retrieval.base import Retrieval
from quillstack.retrieval.vector import blocks

#: Month names, folded (fixed values).
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
CONTEXT_SHARE, CONTEXT_LEAST, NAME_LEAST = 0.02, 200, 12
#: Entries of a dictionary that are broadcast at once.
DICTIONARY_MOST = 1_000_000


@dataclass
class Roles:
    """Columns by what they hold, and the values that chambers are written as."""

    chamber: str = "COLEGIADO"
    process: str = "TIPOPROCESSO"
    reporter: str = "RELATOR"
    date: str = "DATASESSAO"
    entity: str = "ENTIDADE"
    unit: str = "UNIDADETECNICA"
    #: Folded names of chambers and the values they are written as (fixed values).
    chambers: list[tuple[list[str], str]] = field(default_factory=lambda: [(["plenario"], "Plenário"), (["primeira camara", "1a camara", "1 camara"], "Primeira Câmara"), (["segunda camara", "2a camara", "2 camara"], "Segunda Câmara")])
    #: Folded names of the institution that wrote the whole corpus; naming it selects nothing.
    issuers: tuple[str, ...] = ()

    def fields(self) -> list[str]:
        return [self.chamber, self.process, self.reporter, self.date, self.entity, self.unit]


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.where(~is_blank(c)).select(strip(c).alias("value")).distinct()


def process_dictionary(df: DataFrame, c: str) -> DataFrame:
    """(value, name, acronym, stem) of values such as NAME (ACR)."""
    name, acronym = name_and_acronym("value")
    out = distinct_values(df, c).select("value", fold_query(name).alias("name"), fold_query(acronym).alias("acronym"))
    return out.withColumn("stem", stem(F.split("name", " ")[0]))


def component_table(df: DataFrame, c: str) -> DataFrame:
    """(component, folded, identity) of a multivalued field's distinct parts."""
    return df.select(F.explode(components(c)).alias("component")).distinct().select("component", F.regexp_replace(fold_query("component"), r"[. ]+\z", "").alias("folded"), base_identity("component").alias("identity"))


def context_tokens(parts: DataFrame, share: float = CONTEXT_SHARE, least: int = CONTEXT_LEAST) -> DataFrame:
    """(token, df, n_components) of long tokens in at least the share of components; none if there are few components."""
    tokens = parts.select(F.explode(F.array_distinct(F.filter(F.split(fold_query("component"), " "), lambda t: F.length(t) >= 4))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    total = parts.agg(F.count("*").alias("n_components"))
    return tokens.crossJoin(F.broadcast(total)).where((F.col("n_components") >= least) & (F.col("df") >= F.lit(share) * F.col("n_components")))  # one row of totals


def acronym_dictionary(parts: DataFrame) -> DataFrame:
    """(acronym, n_identities, component): the shortest component that carries it, ties by text; unambiguous with one identity."""
    rows = parts.select("component", "identity", F.explode(F.array_distinct(F.transform(all_acronyms("component"), fold_query))).alias("acronym"))
    return rows.groupBy("acronym").agg(F.countDistinct("identity").alias("n_identities"), F.min_by("component", F.struct(F.length("component"), "component")).alias("component"))


def specific(identity: Column, context: Column, issuers: tuple[str, ...]) -> Column:
    """A long token outside the context, and not the issuing institution."""
    tokens = F.filter(F.split(identity, " "), lambda t: F.length(t) >= 4)
    return F.exists(tokens, lambda t: ~F.array_contains(context, t)) & ~identity.isin(*issuers) if issuers else F.exists(tokens, lambda t: ~F.array_contains(context, t))


def bare_head(folded: Column, context: Column) -> Column:
    """A context word and at most one qualifier."""
    tokens = F.split(folded, " ")
    return F.array_contains(context, tokens[0]) & (F.size(F.filter(tokens, lambda t: F.length(t) >= 4)) <= 2)


def best(hits: DataFrame, score: list[Column]) -> DataFrame:
    """Each query's first hit by the order."""
    return hits.withColumn("__turn", F.row_number().over(Window.partitionBy("query_id").orderBy(*score))).where("__turn = 1").drop("__turn")


def met(queries: DataFrame, dictionary: DataFrame, condition: Column, most: int = DICTIONARY_MOST) -> DataFrame:
    """The theta join of questions and a dictionary, which is counted and broadcast in blocks of about `most` entries."""
    return reduce(DataFrame.union, [queries.join(F.broadcast(d), condition) for d in blocks(dictionary, most)])


def match_process(queries: DataFrame, dictionary: DataFrame, most: int = DICTIONARY_MOST) -> DataFrame:
    """(query_id, value): the longest of the acronyms, names and stems a question has."""
    stems = F.transform(F.split("folded_query", " "), stem)
    q = queries.select("query_id", "folded_query", stems.alias("stems"))
    by_acronym = (F.col("acronym") != "") & F.regexp_like("folded_query", F.concat(F.lit(r"\b"), quoted("acronym"), F.lit(r"\b")))
    by_name = (F.col("name") != "") & F.col("folded_query").contains(F.col("name"))
    by_stem = (F.length("stem") >= 5) & F.array_contains("stems", F.col("stem"))
    score = F.greatest(*(F.when(hit, F.length(c)).otherwise(0) for hit, c in ((by_acronym, "acronym"), (by_name, "name"), (by_stem, "stem"))))
    hits = met(q, dictionary, by_acronym | by_name | by_stem, most).withColumn("score", score)
    return best(hits, [F.desc("score"), F.col("value")]).select("query_id", "value")


def match_reporter(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, value) where one person alone is named, in full or by a last name of four letters or more.

    Each question's substrings, of the lengths that names have, meet the names by equality; persons with one name are one row, by
    their first and last value, so neither questions nor persons are compared one by one.
    """
    d = values.select("value", fold_query("value").alias("folded")).withColumn("last", F.element_at(F.split("folded", " "), -1))
    named = d.select("value", F.col("folded").alias("term"), F.lit(True).alias("whole")).union(d.where(F.length("last") >= 4).select("value", "last", F.lit(False)))
    terms = named.groupBy("term", "whole").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lengths = d.select(F.explode(F.array(F.length("folded"), F.length("last"))).alias("n")).agg(F.collect_set("n").alias("lengths"))
    asked = queries.select("query_id", "folded_query").crossJoin(F.broadcast(lengths))  # one row, of at most as many as the longest name has letters
    sized = asked.select("query_id", "folded_query", F.explode("lengths").alias("n")).where(F.length("folded_query") >= F.col("n"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("folded_query") - F.col("n") + 1), lambda i: F.substring(F.col("folded_query"), i, F.col("n"))))
    hits = sized.select("query_id", "folded_query", F.explode(pieces).alias("term")).join(terms, "term")
    alone = F.regexp_like("folded_query", F.concat(F.lit(r"\b"), quoted("term"), F.lit(r"\b")))
    return hits.where(F.col("whole") | alone).groupBy("query_id").agg(F.min("lo").alias("value"), F.max("hi").alias("hi")).where("value = hi").select("query_id", "value")


def match_date(query: Column, folded: Column) -> Column:
    """dd/mm/yyyy as it stands, else 'd de month de yyyy'."""
    slash = F.regexp_extract(query, r"\b(\d{2}/\d{2}/\d{4})\b", 1)
    written = r"\b(\d{1,2})\s+de\s+([a-z]+)\s+de\s+(\d{4})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(folded, written, 2))
    spelled = F.concat_ws("/", F.lpad(F.regexp_extract(folded, written, 1), 2, "0"), F.lpad(month.cast("string"), 2, "0"), F.regexp_extract(folded, written, 3))
    return F.when(slash != "", slash).when(month > 0, spelled)


def match_chamber(folded: Column, chambers: list[tuple[list[str], str]]) -> Column:
    """The first chamber with a name in the question."""
    out = None
    for names, value in chambers:
        hit = reduce(lambda a, b: a | b, (folded.contains(n) for n in names))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def match_acronym(queries: DataFrame, dictionary: DataFrame, guard: Column | None = None, most: int = DICTIONARY_MOST) -> DataFrame:
    """(query_id, value): the component of the longest unambiguous acronym that stands alone in the question."""
    usable = dictionary.where((F.col("n_identities") == 1) & usable_acronym("acronym"))
    if guard is not None:
        usable = usable.where(guard)
    hits = met(queries, usable, mentions("folded_query", "acronym"), most)
    return best(hits, [F.desc(F.length("acronym")), F.col("acronym")]).select("query_id", F.col("component").alias("value"))


def match_name(queries: DataFrame, parts: DataFrame, context: Column, issuers: tuple[str, ...], most: int = DICTIONARY_MOST) -> DataFrame:
    """(query_id, value, n_identities): specific component names that the question holds, the shortest of each identity; a filter only with one."""
    named = parts.where((F.length("folded") >= NAME_LEAST) & specific(F.col("folded"), context, issuers) & ~bare_head(F.col("folded"), context))
    hits = met(queries, named, F.col("folded_query").contains(F.col("folded")), most)
    return hits.groupBy("query_id").agg(F.countDistinct("identity").alias("n_identities"), F.min_by("component", F.struct(F.length("component"), "component")).alias("value"))


class StructuredRetriever:
    """corpus: doc_id and metadata columns. Dictionaries are broadcast in blocks of about `most` entries."""

    def __init__(self, corpus: DataFrame, roles: Roles | None = None, most: int = DICTIONARY_MOST):
        self.corpus, self.roles, self.most = corpus, roles or Roles(), most
        r = self.roles
        self.processes = process_dictionary(corpus, r.process).cache()
        self.reporters = distinct_values(corpus, r.reporter).cache()
        self.entities = component_table(corpus, r.entity).cache()
        self.entity_acronyms = acronym_dictionary(self.entities).cache()
        self.unit_acronyms = acronym_dictionary(component_table(corpus, r.unit)).cache()
        self.context = [x["token"] for x in context_tokens(self.entities).select("token").collect()]  # at most 1 / CONTEXT_SHARE tokens a component has

    def interpret(self, queries: DataFrame) -> DataFrame:
        """(query_id, field, value) of queries(query_id, query)."""
        r = self.roles
        q = queries.select("query_id", "query", fold_query("query").alias("folded_query"))
        context = F.array(*map(F.lit, self.context)).cast("array<string>")
        scalar = q.select("query_id", F.explode(F.array(F.struct(F.lit(r.chamber).alias("field"), match_chamber(F.col("folded_query"), r.chambers).alias("value")), F.struct(F.lit(r.date).alias("field"), match_date(F.col("query"), F.col("folded_query")).alias("value")))).alias("x")).select("query_id", "x.*").where("value is not null")
        by_acronym = match_acronym(q, self.entity_acronyms, specific(base_identity("component"), context, r.issuers), self.most)
        by_name = match_name(q, self.entities, context, r.issuers, self.most).where("n_identities = 1").select("query_id", "value").join(by_acronym, "query_id", "left_anti")
        found = {r.process: match_process(q, self.processes, self.most), r.reporter: match_reporter(q, self.reporters), r.entity: by_acronym.union(by_name), r.unit: match_acronym(q, self.unit_acronyms, most=self.most)}
        return reduce(DataFrame.union, [scalar, *(d.select("query_id", F.lit(f).alias("field"), "value") for f, d in found.items())])

    def conditions(self, query: str) -> dict[str, str]:
        one = self.corpus.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        return {x["field"]: x["value"] for x in self.interpret(one).collect()}

    def predicate(self, conditions: dict[str, str]) -> Column:
        """All conditions at once; none selects nothing. Entities and units match by their folded base name inside the field."""
        r, out = self.roles, []
        for f, v in conditions.items():
            if f in (r.entity, r.unit):
                out.append(fold_query(f).contains(base_identity(F.lit(v))))
            else:
                out.append(strip(f) == F.lit(v))
        return reduce(lambda a, b: a & b, out) if out else F.lit(False)

    def select(self, query: str) -> tuple[DataFrame, dict[str, str]]:
        found = self.conditions(query)
        return self.corpus.where(self.predicate(found)).select("doc_id"), found

    def retrieve(self, query: str) -> Retrieval:
        """The set that meets the conditions, by id, without a score."""
        rows, found = self.select(query)
        out = positioned(rows, ["doc_id"], "rank", 1).withColumn("score", F.lit(None).cast("double")).withColumn("evidence", F.create_map(*(F.lit(x) for kv in found.items() for x in kv)) if found else F.lit(None).cast("map<string,string>"))
        return Retrieval(query, "structured", out, list(found), {"conditions": found, "n_conditions": len(found)})


def conditions_filter(corpus: DataFrame, conditions: DataFrame, fields: list[str], named: tuple[str, ...] = (), most: int = 100_000) -> DataFrame:
    """(query_id, doc_id) for a batch: corpus against the pivoted conditions(query_id, field, value); a query without conditions gets no rows.

    Fields in `named` (entities, units) match by their folded base name inside the document's folded field, as one question's do.
    """
    wide = conditions.groupBy("query_id").pivot("field", fields).agg(F.first("value"))
    wide = wide.withColumns({f: base_identity(F.col(f"`{f}`")) for f in named})
    docs = corpus.select("doc_id", *(fold_query(F.col(f"`{f}`")).alias(f) if f in named else strip(F.col(f"`{f}`")).alias(f) for f in fields))

    def holds(f: str) -> Column:
        own, asked = F.col(f"d.`{f}`"), F.col(f"q.`{f}`")
        return asked.isNull() | (own.contains(asked) if f in named else own == asked)

    both = reduce(lambda a, b: a & b, map(holds, fields))
    return reduce(DataFrame.union, [docs.alias("d").join(F.broadcast(q.alias("q")), both).select("query_id", "doc_id") for q in blocks(wide, most)])



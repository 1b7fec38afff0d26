"""Extraction with a language model: prompts in batches, and answers turned into entities, relations and claims.

The model is a callable from a list of messages to the text of an answer, given by the
caller and run in Arrow batches where the chunks are; CannedClient answers from a list.
Everything after the answer is plain DataFrame work on its JSON.

Defined cases: an answer without JSON, or a failing call, gives nothing for its chunk;
blank names and ends, loops and unknown ends are left out; unknown types take the nearest
known one; missing fields take their defaults.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.functions.causal import ASSERTIVENESS, EVIDENCE
from veinwork.functions.names import claim_id
from veinwork.operators.extract import chunk_rows, first_json, first_seen_relations
from veinwork.sources.graphs import MECHANISM
from veinwork.sources.schemas import Schema

#: Messages (role, content) in, the text of the answer out.
Client = Callable[[list[dict]], str]

ENTITY_TASK = "List the entities that the text names. Answer with JSON: {\"entities\": [{\"name\", \"type\", \"aliases\", \"observations\", \"passage\"}]}. Types:\n%s"
RELATION_TASK = "List the relations between the entities below that the text states. Answer with JSON: {\"relations\": [{\"source\", \"target\", \"type\", \"confidence\", \"passage\"}]}. Types:\n%s\nEntities:\n%s"
CLAIM_TASK = (
    "List each causal claim of the text, one cause and one effect at a time. Answer with JSON: {\"claims\": [{\"source\", \"target\", \"mechanism_name\", \"mechanism_description\", \"direction\", "
    "\"time_lag_min\", \"time_lag_max\", \"conditions\", \"evidence_type\", \"evidence_directness\", \"assertiveness\", \"counterfactual_stated\", \"claim_text\"}]}. Kinds of evidence: " + ", ".join(EVIDENCE)
)
_ENTITIES = "array<struct<name:string,type:string,aliases:array<string>,observations:array<string>,passage:string>>"
_RELATIONS = "array<struct<source:string,target:string,type:string,confidence:double,passage:string>>"
_CLAIMS = (
    "array<struct<source:string,target:string,mechanism_name:string,mechanism_description:string,direction:string,time_lag_min:string,time_lag_max:string,"
    "conditions:array<struct<variable:string,operator:string,threshold:string,description:string>>,evidence_type:string,evidence_directness:string,assertiveness:string,counterfactual_stated:boolean,claim_text:string>>"
)


class CannedClient:
    """Answers from a list in turn, then with empty lists; for tests and dry runs."""

    def __init__(self, answers: list[str] = ()):  # noqa: B006
        self.answers = list(answers)
        self.calls: list[list[dict]] = []

    def __call__(self, messages: list[dict]) -> str:
        self.calls.append(messages)
        return self.answers.pop(0) if self.answers else '{"entities": [], "relations": []}'


def _text_of(task: str, document: str, heading: str | None, text: str) -> list[dict]:
    return [{"role": "system", "content": task}, {"role": "user", "content": f"Document: {document}\nSection: {heading or ''}\n\n{text}"}]


def ask(rows: DataFrame, client: Client, task: str) -> DataFrame:
    """(rows..., answer): the JSON of the client's answer to each chunk, null where there is none. rows has doc_id, heading and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for d, h, t in zip(b["doc_id"], b["heading"], b["text"]):
                try:
                    answers.append(json.dumps(first_json(client(_text_of(task, d, h, t)))))
                except Exception:  # a failing call costs its chunk only
                    answers.append(None)
            yield b.assign(answer=answers)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, answer string")


def section_chunks(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_no, heading, page, chunk_no, text) of sections of at least 20 characters."""
    about = sections.select("doc_id", "sec_no", "heading", F.col("page").cast("int").alias("page"))
    return chunk_rows(sections).select("doc_id", "sec_no", "chunk_no", "text").join(about, ["doc_id", "sec_no"]).select("doc_id", "sec_no", "heading", "page", "chunk_no", "text")


def _typed(df: DataFrame, schema: Schema, kind: str) -> DataFrame:
    """The nearest known type of each raw one; raw types are as many as a model invents, so the map is a join."""
    raws = df.select("raw_type").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(known=[schema.nearest(r, kind) for r in b["raw_type"]])

    return df.join(raws.mapInPandas(run, "raw_type string, known string"), "raw_type").drop("raw_type")


def _stripped(c: str):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def answered_entities(answers: DataFrame, schema: Schema) -> DataFrame:
    """(doc_id, sec_no, chunk_no, pos, name, entity_type, aliases, observations, provenance) of answers with a JSON answer."""
    e = answers.select("doc_id", "sec_no", "heading", "page", "chunk_no", F.posexplode(F.from_json("answer", f"struct<e:{_ENTITIES}>".replace("<e:", "<entities:")).entities).alias("pos", "e"))
    e = e.select("doc_id", "sec_no", "chunk_no", "pos", "heading", "page", _stripped("e.name").alias("name"), _stripped("e.type").alias("raw_type"), "e.aliases", "e.observations", F.left(F.coalesce("e.passage", F.lit("")), F.lit(300)).alias("passage"))
    e = _typed(e.filter("name <> '' AND raw_type <> ''"), schema, "entity_types")
    empty = F.array().cast("array<string>")
    prov = F.struct(F.col("doc_id").alias("document"), F.col("heading").alias("section"), "page", "passage", F.lit(0).alias("char_offset"))
    return e.select("doc_id", "sec_no", "chunk_no", "pos", "name", F.col("known").alias("entity_type"), F.coalesce("aliases", empty).alias("aliases"), F.coalesce("observations", empty).alias("observations"), F.array(prov).alias("provenance"))


def deduplicated(found: DataFrame) -> DataFrame:
    """(doc_id, name, entity_type, aliases, observations, provenance, ord): one entity for each lower-case name of a document; the first's name and type."""
    at = F.struct("sec_no", "chunk_no", "pos")
    key = ["doc_id", F.lower("name").alias("k")]
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  # entities of one document
    out = found.groupBy(*key).agg(F.min_by(F.struct("name", "entity_type"), at).alias("f"), distinct("aliases").alias("aliases"), distinct("observations").alias("observations"),
                                  F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("provenance").alias("p")))), lambda x: x.p)).alias("provenance"), F.min(at).alias("first"))
    return out.select("doc_id", "f.*", "aliases", "observations", "provenance", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("bigint").alias("ord"))


def answered_relations(answers: DataFrame, entities: DataFrame, schema: Schema) -> DataFrame:
    """(doc_id, sec_no, chunk_no, pos, source, target, relation_type, weight, passage) whose ends are entities of the document by their exact names."""
    r = answers.select("doc_id", "sec_no", "chunk_no", F.posexplode(F.from_json("answer", f"struct<relations:{_RELATIONS}>").relations).alias("pos", "r"))
    r = r.select("doc_id", "sec_no", "chunk_no", "pos", _stripped("r.source").alias("source"), _stripped("r.target").alias("target"), _stripped("r.type").alias("raw_type"), F.coalesce("r.confidence", F.lit(0.8)).alias("weight"), F.left(F.coalesce("r.passage", F.lit("")), F.lit(300)).alias("passage"))
    names = entities.select("doc_id", "name").distinct()
    r = r.filter("source <> target").join(names.withColumnRenamed("name", "source"), ["doc_id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["doc_id", "target"], "left_semi")
    return _typed(r, schema, "relation_types").withColumnRenamed("known", "relation_type")


def extract_with_model(sections: DataFrame, schema: Schema, client: Client) -> tuple[DataFrame, DataFrame]:
    """Entities, each once a document, then the relations between them, by two passes of the client over the chunks.

    The second pass tells each chunk the entities of its own document.
    """
    rows = section_chunks(sections)
    entities = deduplicated(answered_entities(ask(rows, client, ENTITY_TASK % schema.entity_lines()), schema))
    listed = entities.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "name", F.lit(" (type: "), "entity_type", F.lit(")")))), "\n").alias("known"))
    told = rows.join(listed, "doc_id").withColumn("text", F.concat("text", F.lit("\n\nEntities:\n"), "known")).drop("known")
    return entities, answered_relations(ask(told, client, RELATION_TASK % (schema.relation_lines(), "as listed after the text")), entities, schema)


def batch_prompts(sections: DataFrame, schema: Schema) -> DataFrame:
    """(value): one JSON line for each chunk with id, prompt, section and document, to be answered elsewhere."""
    stem = F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_no", "chunk_no")) - 1
    prompt = F.concat(F.lit(ENTITY_TASK % schema.entity_lines()), F.lit("\n\nDocument: "), "doc_id", F.lit("\nSection: "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), "text")
    return section_chunks(sections).select(F.to_json(F.struct(
        F.concat(stem, F.lit("_"), number.cast("string"), F.lit("_chunk"), F.col("chunk_no").cast("string")).alias("id"), prompt.alias("prompt"), F.coalesce("heading", F.lit("")).alias("section"), F.col("doc_id").alias("document"),
    )).alias("value"))


def batch_responses(lines: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of answered lines (line_no, value); a relation counts if both ends were named on its line or before.

    A line that is no JSON is an error of the query that reads it; blank lines are skipped.
    """
    shape = f"struct<id:string,document:string,section:string,response:struct<entities:{_ENTITIES},relations:{_RELATIONS}>>"
    j = lines.filter(F.trim("value") != "").select("line_no", F.from_json("value", shape, {"mode": "FAILFAST"}).alias("j"))
    j = j.select("line_no", F.coalesce("j.document", "j.id", F.lit("unknown")).alias("document"), F.coalesce("j.section", F.lit("")).alias("section"), "j.response")
    as_answers = j.select(F.lit("").alias("doc_id"), F.col("line_no").alias("sec_no"), F.col("section").alias("heading"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("chunk_no"), F.to_json("response").alias("answer"))
    documents = j.select(F.col("line_no").alias("sec_no"), "document")
    found = answered_entities(as_answers, schema).join(documents, "sec_no")
    found = found.withColumn("provenance", F.transform("provenance", lambda p: p.withField("document", F.col("document"))))
    names = found.select("name", F.col("sec_no").alias("line_no"))
    r = j.select("line_no", "document", F.posexplode("response.relations").alias("pos", "r")).select(
        "line_no", "document", "pos", _stripped("r.source").alias("source"), _stripped("r.target").alias("target"), _stripped("r.type").alias("raw_type"), F.coalesce("r.confidence", F.lit(0.8)).alias("weight"))
    relations = _typed(first_seen_relations(names, r.filter("source <> target")), schema, "relation_types").withColumnRenamed("known", "relation_type")
    return deduplicated(found.drop("document")).drop("doc_id"), relations


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file, read whole, since lines count in its order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def built_claims(answers: DataFrame) -> DataFrame:
    """Causal claims of answers: unknown evidence is narrative, unknown assertiveness moderate, unknown directness cited.

    The direction of the claim is one of the four known or ambiguous; that of its mechanism
    stays as answered. Conditions need a variable.
    """
    c = answers.select("doc_id", "sec_no", "heading", "page", "chunk_no", F.posexplode(F.from_json("answer", f"struct<claims:{_CLAIMS}>").claims).alias("pos", "c"))
    c = c.select("doc_id", "sec_no", "heading", "page", "chunk_no", "pos", _stripped("c.source").alias("source"), _stripped("c.target").alias("target"), "c").filter("source <> '' AND target <> '' AND source <> target")
    among = lambda x, known, default: F.when(F.col(x).isin(*known), F.col(x)).otherwise(default)
    text = F.coalesce("c.claim_text", F.lit(""))
    evidence = among("c.evidence_type", EVIDENCE, "narrative")
    given = F.filter(F.coalesce("c.conditions", F.array().cast("array<struct<variable:string,operator:string,threshold:string,description:string>>")), lambda x: F.coalesce(x.variable, F.lit("")) != "")
    conditions = F.transform(given, lambda x: F.struct(x.variable.alias("variable"), F.coalesce(x.operator, F.lit("regime_is")).alias("operator"), F.coalesce(x.threshold, F.lit("")).alias("threshold"), F.coalesce(x.description, F.lit("")).alias("description"), F.lit(None).cast("boolean").alias("currently_met")))
    mechanism = F.struct(
        F.coalesce("c.mechanism_name", F.lit("unspecified")).alias("name"), F.coalesce("c.mechanism_description", F.lit("")).alias("description"), F.coalesce("c.direction", F.lit("ambiguous")).alias("direction"), F.lit(False).alias("nonlinear"),
        F.lit(None).cast("array<double>").alias("elasticity_range"), F.lit(None).cast("string").alias("elasticity_horizon"), F.lit(None).cast("string").alias("elasticity_source"), F.col("c.time_lag_min").alias("time_lag_min"), F.col("c.time_lag_max").alias("time_lag_max"), conditions.alias("conditions"),
    ).cast(MECHANISM)
    prov = F.struct(F.col("doc_id").alias("document"), F.col("heading").alias("section"), "page", F.left(text, F.lit(300)).alias("passage"), F.lit(0).alias("char_offset"))
    return c.select(
        claim_id(F.col("source"), F.col("target"), evidence, text).alias("id"), "source", "target", F.array(mechanism).alias("mechanisms"), evidence.alias("evidence_type"), F.lit(1).alias("evidence_count"),
        among("c.evidence_directness", ("primary", "cited", "secondary_citation"), "cited").alias("evidence_directness"), among("c.assertiveness", ASSERTIVENESS, "moderate").alias("claim_assertiveness"),
        among("c.direction", ("positive", "negative", "ambiguous", "state_dependent"), "ambiguous").alias("net_direction"), F.coalesce("c.counterfactual_stated", F.lit(False)).alias("counterfactual_stated"),
        F.array(prov).alias("sources"), text.alias("claim_text"), F.lit("llm").alias("extracted_by"), F.struct("doc_id", "sec_no", "chunk_no", "pos").alias("at"),
    )


def extract_claims(sections: DataFrame, client: Client) -> DataFrame:
    """Claims that the client finds in the chunks, each id once, the last."""
    found = built_claims(ask(section_chunks(sections), client, CLAIM_TASK))
    return found.groupBy("id").agg(F.max_by(F.struct(*found.columns), "at").alias("c")).select("c.*").drop("at")


def manual_claim(spark: SparkSession, source: str, target: str, mechanism: str, evidence_type: str = "narrative", direction: str = "positive", assertiveness: str = "moderate", note: str = "") -> DataFrame:
    """One claim put in by hand, in the form of built_claims."""
    answer = json.dumps({"claims": [{"source": source, "target": target, "mechanism_name": mechanism, "mechanism_description": note, "direction": direction, "evidence_type": evidence_type, "assertiveness": assertiveness, "claim_text": note}]})
    rows = spark.createDataFrame([("manual", 0, "", None, 0, answer)], "doc_id string, sec_no int, heading string, page int, chunk_no int, answer string")
    return built_claims(rows).withColumn("extracted_by", F.lit("manual")).drop("at")

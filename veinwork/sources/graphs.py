"""Readers and writers of graph interchange formats.

Graph files are read whole by Spark and taken apart by from_json; missing fields take
their defaults, unknown ones are ignored. Writers give one row for each line, so that any
of them can be written by write.text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = "struct<document:string,section:string,page:int,passage:string,char_offset:int>"
CODE_ANCHOR = "struct<repo:string,path:string,line:int,symbol:string>"
CITATION = "struct<key:string,pages:string>"
ENTITY = (
    f"struct<name:string,entity_type:string,aliases:array<string>,observations:array<string>,provenance:array<{PROVENANCE}>,metadata:map<string,string>,"
    f"code_anchors:array<{CODE_ANCHOR}>,citation_anchors:array<{CITATION}>,abstract:boolean,abstract_rationale:string,confidence:double>"
)
RELATION = (
    f"struct<source:string,target:string,relation_type:string,weight:double,provenance:array<{PROVENANCE}>,metadata:map<string,string>,"
    "sign:string,lag:string,form:string,conditional_on:array<string>,edge_class:string,confidence:double>"
)
CONDITION = "struct<variable:string,operator:string,threshold:string,description:string,currently_met:boolean>"
MECHANISM = (
    "struct<name:string,description:string,direction:string,nonlinear:boolean,elasticity_range:array<double>,elasticity_horizon:string,elasticity_source:string,"
    f"time_lag_min:string,time_lag_max:string,conditions:array<{CONDITION}>>"
)
CLAIM = (
    f"struct<id:string,source:string,target:string,mechanisms:array<{MECHANISM}>,causal_type:string,evidence_type:string,evidence_count:int,evidence_directness:string,"
    "claim_assertiveness:string,confidence:double,strength:string,net_direction:string,direction_contested:boolean,geographic_scope:string,geographic_entities:array<string>,"
    f"temporal_scope:string,reversibility:string,sources:array<{PROVENANCE}>,claim_text:string,counterfactual_stated:boolean,extracted_by:string,contradicted_by:array<string>,"
    "superseded_by:string,asset_classes:array<string>,sector_codes:array<string>>"
)
# What a missing field of a relation or entity stands for.
RELATION_DEFAULTS = {"weight": 1.0, "sign": "unknown", "lag": "unknown", "form": "unknown", "edge_class": "mechanism", "confidence": 1.0}
ENTITY_DEFAULTS = {"abstract": False, "abstract_rationale": "", "confidence": 1.0}


def _filled(df: DataFrame, defaults: dict) -> DataFrame:
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in defaults:
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit(defaults[f.name])))
        elif kind.startswith("array"):
            df = df.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    return df


def _file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, documents) of a graph file; ord numbers entities and relations in the order of the file."""
    j = _file(spark, path, f"struct<schema_name:string,documents:array<string>,entities:map<string,{ENTITY}>,relations:array<{RELATION}>>")
    e = j.select(F.posexplode(F.map_values("j.entities")).alias("ord", "e")).select(F.col("ord").cast("bigint"), "e.*")
    r = j.select(F.posexplode("j.relations").alias("ord", "r")).select(F.col("ord").cast("bigint"), "r.*")
    return _filled(e, ENTITY_DEFAULTS), _filled(r, RELATION_DEFAULTS), j.select(F.explode("j.documents").alias("document"))


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(claims, regime) of a causal graph file; ord numbers claims in the order of the file."""
    j = _file(spark, path, f"struct<claims:map<string,{CLAIM}>,regime_context:map<string,string>>")
    c = j.select(F.posexplode(F.map_values("j.claims")).alias("ord", "c")).select(F.col("ord").cast("bigint"), "c.*")
    regime = j.select("j.regime_context").first()
    return _filled(c, {"evidence_count": 1, "confidence": 0.0}), dict((regime and regime[0]) or {})


def _records(df: DataFrame, key: Column, drop: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(k, v, ord): each row as JSON under its key; null fields are written."""
    cols = [c for c in df.columns if c not in drop]
    at = F.col("ord") if "ord" in df.columns else F.lit(0)
    return df.select(key.alias("k"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("v"), at.alias("ord"))


def graph_lines(entities: DataFrame, relations: DataFrame, documents: DataFrame | None = None, schema_name: str = "base") -> DataFrame:
    """(pos, value): a graph file that read_graph reads back, one row for each line; sort by pos before writing to one file."""
    return _object_lines(
        entities.sparkSession, [("schema_name", F.to_json(F.struct(F.lit(schema_name).alias("s"))))], [("entities", _records(entities, F.col("name")), True), ("relations", _records(relations, F.lit("")), False)],
        documents,
    )


def _object_lines(spark: SparkSession, scalars: list, parts: list, documents: DataFrame | None) -> DataFrame:
    pos = "struct<part:int,ord:bigint,key:string>"
    at = lambda part, o="0", k="''": F.expr(f"named_struct('part', {part}, 'ord', cast({o} as bigint), 'key', {k})")
    line = lambda part, text: spark.range(1).select(at(part).alias("pos"), F.lit(text).alias("value") if isinstance(text, str) else text.alias("value"))
    out = line(0, "{")
    n = 1
    for name, value in scalars:
        out = out.unionByName(line(n, F.concat(F.lit(f'"{name}": '), F.regexp_extract(value, r'^\{"s":(.*)\}$', 1), F.lit(","))))
        n += 1
    if documents is not None:
        docs = F.to_json(F.sort_array(F.collect_set("document")))
        out = out.unionByName(documents.agg(docs.alias("d")).select(at(n).alias("pos"), F.concat(F.lit('"documents": '), "d", F.lit(",")).alias("value")))
        n += 1
    for i, (name, rows, keyed) in enumerate(parts):
        # a leading comma for every record but the first keeps each line independent of its followers; equal records share a line
        rows = rows.groupBy("ord", "k", "v").agg(F.count("*").alias("times"))
        first = rows.agg(F.min(F.struct("ord", "k", "v")).alias("m"))
        entry = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("k").alias("s"))), r'^\{"s":(.*)\}$', 1), F.lit(": "), "v") if keyed else F.col("v")
        body = rows.join(F.broadcast(first)).select(
            at(n + 1, "ord", "k").alias("pos"),
            F.concat(F.when(F.struct("ord", "k", "v").eqNullSafe(F.col("m")), "  ").otherwise(", "), F.array_join(F.array_repeat(entry, F.col("times").cast("int")), ", ")).alias("value"),
        )
        out = out.unionByName(line(n, f'"{name}": ' + ("{" if keyed else "["))).unionByName(body).unionByName(line(n + 2, ("}" if keyed else "]") + ("," if i + 1 < len(parts) else "")))
        n += 3
    return out.unionByName(line(n, "}")).select(F.col("pos").cast(pos), "value")


def claim_lines(claims: DataFrame, regime: dict[str, str] | None = None, build_date: str = "") -> DataFrame:
    """(pos, value): a causal graph file that read_claims reads back; of claims with one id the last stands."""
    last = claims.groupBy("id").agg(F.max_by(F.struct(*claims.columns), "ord").alias("c")).select("c.*")
    spark = claims.sparkSession
    as_json = lambda v: F.to_json(F.struct(v.alias("s")))
    regime_map = F.create_map(*[F.lit(x) for kv in (regime or {}).items() for x in kv]).cast("map<string,string>")
    names = last.select(F.explode(F.array("source", "target")).alias("n")).filter("n IS NOT NULL").distinct()
    ents = names.select(F.col("n").alias("k"), F.regexp_extract(as_json(F.col("n")), r'^\{"s":(.*)\}$', 1).alias("v"), F.lit(0).cast("bigint").alias("ord"))
    return _object_lines(spark, [("schema_name", as_json(F.lit("causal"))), ("build_date", as_json(F.lit(build_date))), ("regime_context", as_json(regime_map))],
                         [("claims", _records(last, F.col("id")), True), ("entities", ents, False)], None)


def write_lines(lines: DataFrame, path: str) -> int:
    """Lines sorted by pos into one local file, streamed part by part; returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for r in (lines.orderBy("pos", "value") if "pos" in lines.columns else lines).select("value").toLocalIterator():
            f.write(r.value + "\n")
            n += 1
    return n


def memory_lines(entities: DataFrame, relations: DataFrame, prefix: str) -> DataFrame:
    """(value): JSON lines of a memory store; names carry the prefix if there is one, ten observations at most."""
    named = lambda c: F.concat(F.lit(f"{prefix}:"), c) if prefix else F.col(c)
    e = entities.select(F.to_json(F.struct(F.lit("entity").alias("type"), named("name").alias("name"), F.col("entity_type").alias("entityType"), F.slice(F.coalesce("observations", F.array().cast("array<string>")), 1, 10).alias("observations"))).alias("value"))
    r = relations.select(F.to_json(F.struct(F.lit("relation").alias("type"), named("source").alias("from"), named("target").alias("to"), F.col("relation_type").alias("relationType"))).alias("value"))
    return e.unionByName(r)


def write_memory(entities: DataFrame, relations: DataFrame, prefix: str, path: str, append: bool = True) -> int:
    """Memory lines into a folder of text files, after those that are there or in their place; returns how many."""
    lines = memory_lines(entities, relations, prefix).persist()
    n = lines.count()
    lines.write.mode("append" if append else "overwrite").text(path)
    lines.unpersist()
    return n


def read_memory(spark: SparkSession, path: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations under a prefix, or all without one; blank and broken lines are skipped, a missing file is an empty store."""
    schema = "type string, name string, entityType string, observations array<string>, `from` string, `to` string, relationType string"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    lines = spark.read.text(path) if there else spark.createDataFrame([], "value string")
    rows = lines.select(F.from_json("value", schema).alias("j")).filter("j.type IS NOT NULL").select("j.*")
    p = f"{prefix}:" if prefix else ""
    cut = lambda c: F.expr(f"substring({c}, {len(p) + 1})")
    ents = rows.filter((F.col("type") == "entity") & F.col("name").startswith(p)).select(cut("name").alias("name"), F.coalesce("entityType", F.lit("concept")).alias("entity_type"), "observations")
    rels = rows.filter((F.col("type") == "relation") & F.col("from").startswith(p) & F.col("to").startswith(p)).select(cut("`from`").alias("source"), cut("`to`").alias("target"), F.coalesce("relationType", F.lit("relates_to")).alias("relation_type"))
    return ents, rels


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, pages) from a JSON list of records, or a map of names to keys or records."""
    text = spark.read.text(path, wholetext=True)
    listed = text.filter(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", "array<struct<name:string,key:string,pages:string>>")).alias("r")).select("r.*")
    mapped = text.filter(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "v"))
    record = F.from_json("v", "struct<key:string,pages:string>")
    mapped = mapped.select("name", F.coalesce(record.key, "v").alias("key"), record.pages.alias("pages"))
    return listed.unionByName(mapped).filter("name IS NOT NULL AND key IS NOT NULL").withColumn("pages", F.coalesce("pages", F.lit("")))


def mermaid_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, value): a Mermaid graph, one row for each line; nodes without a type are concepts."""
    safe = lambda c: F.translate(F.translate(c, " ", "_"), '"', "'")
    head = entities.sparkSession.createDataFrame([(0, "graph LR")], "pos int, value string")
    nodes = entities.select(F.lit(1).alias("pos"), F.format_string('    %s["%s<br/><i>%s</i>"]', safe("name"), "name", F.coalesce("entity_type", F.lit("concept"))).alias("value"))
    arrows = edges.select(F.lit(2).alias("pos"), F.format_string("    %s -->|%s| %s", safe("source"), F.coalesce("relation_type", F.lit("relates_to")), safe("target")).alias("value"))
    return head.unionByName(nodes).unionByName(arrows)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, value): a GraphML file, one row for each line; lists are joined by semicolons, nulls have no data element."""
    spark = entities.sparkSession
    lists = [c for c in ("aliases", "observations") if c in entities.columns]
    node_keys = ["entity_type", *lists]
    edge_keys = [c for c in ("relation_type", "weight") if c in edges.columns]
    top = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    top += [f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in node_keys]
    top += [f'<key id="{k}" for="edge" attr.name="{k}" attr.type="{"double" if k == "weight" else "string"}"/>' for k in edge_keys]
    head = spark.createDataFrame([(i - 100, v) for i, v in enumerate([*top, '<graph edgedefault="directed">'])], "pos int, value string")

    def data(c: str) -> Column:
        text = F.array_join(c, ";") if c in lists else F.col(c).cast("string")
        return F.coalesce(F.concat(F.lit(f'<data key="{c}">'), _escaped(text), F.lit("</data>")), F.lit(""))

    nodes = entities.select(F.lit(1).alias("pos"), F.concat(F.lit('<node id="'), _escaped(F.col("name")), F.lit('">'), *[data(c) for c in node_keys], F.lit("</node>")).alias("value"))
    arrows = edges.select(F.lit(2).alias("pos"), F.concat(F.lit('<edge source="'), _escaped(F.col("source")), F.lit('" target="'), _escaped(F.col("target")), F.lit('">'), *[data(c) for c in edge_keys], F.lit("</edge>")).alias("value"))
    return head.unionByName(nodes).unionByName(arrows).unionByName(spark.createDataFrame([(3, "</graph>"), (4, "</graphml>")], "pos int, value string"))


def jsonld_lines(entities: DataFrame, edges: DataFrame, vocabulary: str = "urn:veinwork:") -> DataFrame:
    """(pos, value): entities and edges as linked data under a vocabulary, one row for each line."""
    from veinwork.functions.names import entity_id

    spark = entities.sparkSession
    context = F.to_json(F.struct(F.struct(F.lit(vocabulary).alias("v"), *[F.lit(f"v:{t}").alias(k) for k, t in (("name", "name"), ("type", "entityType"), ("source", "source"), ("target", "target"), ("relationType", "relationType"))]).alias("s")))
    e = entities.select("name", F.to_json(F.struct(F.concat(F.lit("v:entity/"), entity_id(F.col("name"))).alias("@id"), "name", F.col("entity_type").alias("type"), F.coalesce("observations", F.array().cast("array<string>")).alias("observations"))).alias("v"))
    r = edges.select(F.concat_ws("\u0001", "source", "target").alias("k"), F.to_json(F.struct("source", "target", F.coalesce("relation_type", F.lit("relates_to")).alias("relationType"))).alias("v"))
    zero = F.lit(0).cast("bigint").alias("ord")
    return _object_lines(spark, [("@context", context)], [("entities", e.select(F.col("name").alias("k"), "v", zero), False), ("relations", r.select("k", "v", zero), False)], None)


def diff_lines(diff: DataFrame, old: str, new: str) -> DataFrame:
    """(pos, value): the changes of graph_diff as a Markdown report with counts."""
    spark = diff.sparkSession
    title = spark.createDataFrame([(0, "", f"# Changes from {old} to {new}")], "pos int, k string, value string")
    heads = diff.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(1).alias("pos"), F.col("change").alias("k"), F.format_string("- %s: %d", F.translate("change", "_", " "), "n").alias("value"))
    items = diff.select(F.lit(1).alias("pos"), F.concat("change", F.lit(" "), "what").alias("k"), F.concat(F.lit("  - `"), "what", F.lit("`")).alias("value"))
    return title.unionByName(heads).unionByName(items).select(F.struct("pos", "k").alias("pos"), "value")

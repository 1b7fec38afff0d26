"""The command line: documents to graphs, and graphs to merged graphs, reports and other formats.

Every command builds DataFrames and writes them; a command returns its exit code. Run
it as python -m veinwork.cli.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import causal as C
from veinwork.operators import agree, assisted, extract, resolve
from veinwork.operators import graph as G
from veinwork.operators import quality as Q
from veinwork.session import local_session
from veinwork.sources import documents as D
from veinwork.sources import graphs as S
from veinwork.sources.schemas import Schema, load_schema


def _client(name: str | None) -> assisted.Client:
    """A client named as module:attribute; without a name one that finds nothing."""
    if not name or name == "mock":
        return assisted.CannedClient()
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def _sections(spark: SparkSession, path: str) -> DataFrame:
    return D.sections_table(D.read_documents(spark, path))


def _by_rules(sections: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Entities and relations by the patterns, over all documents; one record for each document and name."""
    found = extract.document_entities(extract.entity_mentions(sections), schema).persist()
    relations = extract.relation_mentions(sections, found, list(schema.relation_types))
    order = F.struct("doc_id", "sec_no", "pattern", "char_offset")
    return found.withColumn("ord", F.xxhash64("doc_id", "name")), relations.withColumn("ord", F.xxhash64(order)).withColumn("weight", F.lit(0.5))


def _with_model(sections: DataFrame, schema: Schema, client: assisted.Client) -> tuple[DataFrame, DataFrame]:
    e, r = assisted.extract_with_model(sections, schema, client)
    return e.withColumn("ord", F.xxhash64("doc_id", "name")), r.withColumn("ord", F.xxhash64("doc_id", "sec_no", "chunk_no", "pos"))


def _code(spark: SparkSession, repo: str, schema: Schema) -> DataFrame:
    return extract.code_records(D.source_files(spark, repo), schema.code_patterns())


_EMPTY = {"aliases": "array<string>", "observations": "array<string>", "provenance": f"array<{S.PROVENANCE}>", "code_anchors": f"array<{S.CODE_ANCHOR}>", "citation_anchors": f"array<{S.CITATION}>"}


def _complete(entities: DataFrame) -> DataFrame:
    """Entities with all fields that a graph file holds."""
    for c, kind in _EMPTY.items():
        if c not in entities.columns or c == "provenance":
            entities = entities.withColumn(c, F.array().cast(kind))
    for c, v in {"confidence": 1.0, "abstract": False}.items():
        if c not in entities.columns:
            entities = entities.withColumn(c, F.lit(v))
    return entities.select("ord", "name", "entity_type", *_EMPTY, "confidence", "abstract")


def _save(path: str, entities: DataFrame, relations: DataFrame, schema: str = "base") -> None:
    S.write_lines(S.graph_lines(entities, relations, None, schema), path)


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = load_schema(a.schema, a.schema_folder)
    if a.dual_extract and not a.ast_repo:
        print("--dual-extract needs --ast-repo", file=sys.stderr)
        return 1
    if a.batch_in:
        entities, relations = assisted.batch_responses(assisted.read_lines(spark, a.batch_in), schema)
        _save(a.output, _complete(entities), relations.withColumn("ord", F.xxhash64("line_no", "pos")).select("ord", "source", "target", "relation_type", F.col("confidence" if "confidence" in relations.columns else "weight").alias("weight")), schema.name)
        return 0
    sections = _sections(spark, a.input).persist()
    if a.batch_out:
        S.write_lines(assisted.batch_prompts(sections, schema), a.batch_out)
        return 0
    entities, relations = _with_model(sections, schema, _client(a.client)) if a.llm else _by_rules(sections, schema)
    entities, relations = _complete(entities), relations.select("ord", "source", "target", "relation_type", "weight")
    if a.ast_repo:
        code = _complete(_code(spark, a.ast_repo, schema))
        if a.dual_extract:
            none = relations.limit(0).withColumn("sign", F.lit("unknown"))
            out = agree.merge_extractions(entities, relations.withColumn("sign", F.lit("unknown")), code, none)
            entities, relations = out["agreement_entities"].withColumn("ord", F.coalesce("code_ord", "text_ord")), out["agreement_relations"]
        else:
            entities = entities.unionByName(code)
    merged = G.merged_entities(entities)
    _save(a.output, merged, relations, schema.name)
    if a.quality_report:
        _report(Q.quality_report(merged.withColumn("abstract", F.lit(False)), _mechanisms(relations), schema.validation), a.quality_report)
    return 0


def _mechanisms(relations: DataFrame) -> DataFrame:
    for c, v in S.RELATION_DEFAULTS.items():
        if c not in relations.columns:
            relations = relations.withColumn(c, F.lit(v))
    return relations


def _report(rows: DataFrame, path: str) -> list:
    """A few rows of metrics as a JSON list."""
    found = [r.asDict() for r in rows.collect()]
    Path(path).write_text(json.dumps(found, indent=2), encoding="utf-8")
    return found


def merge(spark: SparkSession, a: argparse.Namespace) -> int:
    read = [S.read_graph(spark, p) for p in a.inputs]
    entities, relations = resolve.merge_graphs([r[0] for r in read], [r[1] for r in read], a.threshold)
    _save(a.output, entities, relations)
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    entities, relations, _ = S.read_graph(spark, a.input)
    edges = G.collapsed_edges(relations)
    G.summary(relations, entities).show(100, False)
    if a.cycles or a.all:
        G.simple_cycles(edges).orderBy("length", "path").show(10, False)
    if a.centrality or a.all:
        G.degree_centrality(edges).orderBy(F.desc("centrality"), "name").show(15, False)
    if a.cascade_depth or a.all:
        types = [r[0] for r in edges.select("relation_type").distinct().orderBy("relation_type").limit(1000).collect()]
        for t in types:
            print(t, G.cascade_depth(edges.filter(F.col("relation_type").eqNullSafe(F.lit(t)))))
    return 0


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    entities, relations, _ = S.read_graph(spark, a.input)
    edges = G.collapsed_edges(relations)
    lines: Callable = {"graphml": S.graphml_lines, "mermaid": S.mermaid_lines, "jsonld": S.jsonld_lines}[a.format]
    S.write_lines(lines(entities, edges), a.output or str(Path(a.input).with_suffix(f".{a.format}")))
    return 0


def subgraph(spark: SparkSession, a: argparse.Namespace) -> int:
    entities, relations, _ = S.read_graph(spark, a.input)
    near = G.k_hop(relations, a.root, a.depth).select("name")
    _save(a.output, entities.join(near, "name", "left_semi"), G.induced_subgraph(relations, near))
    return 0


def memory_sync(spark: SparkSession, a: argparse.Namespace) -> int:
    entities, relations, _ = S.read_graph(spark, a.input)
    print(S.write_memory(entities, G.collapsed_edges(relations), a.prefix, a.output, not a.overwrite))
    return 0


def quality(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = load_schema(a.schema, a.schema_folder)
    entities, relations, _ = S.read_graph(spark, a.input)
    code = _code(spark, a.ast_repo, schema) if a.ast_repo else None
    rows = _report(Q.quality_report(entities, relations, schema.validation, code), a.output or str(Path(a.input).with_suffix(".quality.json")))
    return 1 if any(r["passed"] is False for r in rows) and not a.allow_gate_failure else 0


def cross_check(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = load_schema(a.schema, a.schema_folder)
    entities, relations = _with_model(_sections(spark, a.input).persist(), schema, _client(a.client))
    code = _complete(_code(spark, a.ast_repo, schema))
    signed = relations.withColumn("sign", F.lit("unknown"))
    out = agree.merge_extractions(_complete(entities), signed, code, signed.limit(0))
    _save(a.output, G.merged_entities(out["agreement_entities"].withColumn("ord", F.coalesce("code_ord", "text_ord")).withColumn("confidence", F.lit(1.0))), out["agreement_relations"], schema.name)
    counts = {k: v.count() for k, v in out.items()}
    Path(a.report or Path(a.output).with_suffix(".merge_report.json")).write_text(json.dumps(counts, indent=2), encoding="utf-8")
    return 0


def ground(spark: SparkSession, a: argparse.Namespace) -> int:
    entities, relations, documents = S.read_graph(spark, a.kg)
    cited = S.read_citations(spark, a.citation_bib) if a.citation_bib else None
    out = agree.grounded(entities, _code(spark, a.ast_repo, load_schema(a.schema, a.schema_folder)), cited)
    lines = S.graph_lines(out, relations, documents).persist()
    lines.count()  # read before the file is written over
    S.write_lines(lines, a.kg if a.in_place else a.output or str(Path(a.kg).with_suffix(".grounded.json")))
    return 0


def diff(spark: SparkSession, a: argparse.Namespace) -> int:
    (oe, orel, _), (ne, nrel, _) = S.read_graph(spark, a.old), S.read_graph(spark, a.new)
    S.write_lines(S.diff_lines(G.graph_diff(oe, ne, orel, nrel), Path(a.old).name, Path(a.new).name), a.report)
    return 0


def falsify(spark: SparkSession, a: argparse.Namespace) -> int:
    _, relations, _ = S.read_graph(spark, a.kg)
    module, _, name = a.simulator.partition(":")
    adapter = getattr(importlib.import_module(module), name)()
    verdicts = Q.falsify(relations, Q.simulated_signs(relations, adapter), a.subset)
    _report(verdicts.groupBy("verdict").agg(F.count("*").alias("n")), a.report or str(Path(a.kg).with_suffix(".falsify.json")))
    return 0


def causal_ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    _save_claims(assisted.extract_claims(_sections(spark, a.input), _client(a.client)), a.output)
    return 0


def causal_add(spark: SparkSession, a: argparse.Namespace) -> int:
    new = assisted.manual_claim(spark, a.source, a.target, a.mechanism, a.evidence_type, a.direction, a.assertiveness, a.note or "")
    if Path(a.output).exists():
        old, _ = S.read_claims(spark, a.output)
        new = old.unionByName(new.withColumn("ord", F.lit(1 << 40)), allowMissingColumns=True).persist()
        new.count()  # read before the file is written over
    _save_claims(new, a.output)
    return 0


def _save_claims(claims: DataFrame, path: str) -> None:
    if "ord" not in claims.columns:
        claims = claims.withColumn("ord", F.xxhash64("id"))
    e, x = C.lookup(F.col("evidence_type"), C.EVIDENCE, 0.15), C.lookup(F.col("claim_assertiveness"), C.ASSERTIVENESS, 0.2)
    score = C.confidence(e, F.lit(0.5), C.mechanism_score(F.col("mechanisms")), C.diversity_score(F.col("evidence_count")), x)
    scored = claims.withColumn("confidence", score).withColumn("strength", C.strength(F.col("confidence")))
    S.write_lines(S.claim_lines(scored), path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinwork")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *args: tuple, into=sub) -> argparse.ArgumentParser:
        c = into.add_parser(name)
        for names, options in args:
            c.add_argument(*names.split(), **options)
        c.set_defaults(run=run)
        return c

    yes, schema = {"action": "store_true"}, [("--schema", {"default": "base"}), ("--schema-folder", {"default": None})]
    client = ("--client", {"default": None, "help": "module:attribute of a callable that answers messages"})
    command("ingest", ingest, ("input", {}), *schema, ("--output -o", {"default": "graph.json"}), ("--llm", yes), client, ("--batch-out", {}), ("--batch-in", {}), ("--ast-repo", {}), ("--dual-extract", yes), ("--quality-report", {}))
    command("merge", merge, ("inputs", {"nargs": "+"}), ("--output -o", {"default": "merged.json"}), ("--threshold", {"type": float, "default": 0.85}))
    command("analyze", analyze, ("input", {}), ("--cycles", yes), ("--centrality", yes), ("--cascade-depth", yes), ("--all", yes))
    command("export", export, ("input", {}), ("--format -f", {"choices": ["graphml", "mermaid", "jsonld"], "required": True}), ("--output -o", {}))
    command("extract", subgraph, ("input", {}), ("--root -r", {"required": True}), ("--depth -d", {"type": int, "default": 2}), ("--output -o", {"default": "subgraph.json"}))
    command("memory-sync", memory_sync, ("input", {}), ("--prefix", {"default": "veinwork"}), ("--output -o", {"required": True}), ("--overwrite", yes))
    command("quality", quality, ("input", {}), *schema, ("--ast-repo", {}), ("--output -o", {}), ("--allow-gate-failure", yes))
    command("cross-check", cross_check, ("input", {}), ("--ast-repo", {"required": True}), *schema, client, ("--output -o", {"default": "agreement.json"}), ("--report", {}))
    command("ground", ground, ("--kg", {"required": True}), ("--ast-repo", {"required": True}), *schema, ("--citation-bib", {}), ("--in-place", yes), ("--output -o", {}))
    command("diff", diff, ("--old", {"required": True}), ("--new", {"required": True}), ("--report", {"required": True}))
    command("falsify", falsify, ("--kg", {"required": True}), ("--simulator", {"required": True}), ("--subset", {"choices": ["mechanism", "all"], "default": "mechanism"}), ("--report", {}))
    causal = sub.add_parser("causal").add_subparsers(dest="causal_command", required=True)
    command("ingest", causal_ingest, ("input", {}), ("--output -o", {"default": "causal_graph.json"}), client, into=causal)
    command("add", causal_add, ("--source", {"required": True}), ("--target", {"required": True}), ("--mechanism", {"required": True}), ("--evidence-type", {"default": "narrative"}), ("--direction", {"default": "positive"}),
            ("--assertiveness", {"default": "moderate"}), ("--note", {}), ("--output -o", {"default": "causal_graph.json"}), into=causal)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or local_session("veinwork-cli"), a)


if __name__ == "__main__":
    sys.exit(main())

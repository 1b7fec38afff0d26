import json

import pytest
from pyspark.sql import functions as F

from veinwork import cli
from veinwork.operators import assisted as A
from veinwork.operators import extract as X
from veinwork.sources import documents as D
from veinwork.sources import graphs as S
from veinwork.sources.schemas import Schema, load_schema
from veinwork.streaming import ingest as I


def test_sections_chunks_and_json(spark):
    assert X.markdown_sections("intro\n# A\nx\n## B\n\n# C\ny") == [("Introduction", 1, "intro"), ("A", 1, "x"), ("C", 1, "y")]
    assert X.html_sections("<h1>A</h1><p>x</p><h2>B</h2>z<p>w</p>") == [("A", 1, "x"), ("B", 2, "z\nw")]
    assert X.html_sections("<div><h1>A</h1></div><p>not beside it</p>") == [] and X.html_sections("<p>a</p><p>b") == [("Full Text", 1, "a\nb")]
    assert X.html_title("<title> T </title><h1>H</h1>") == "T" and X.html_title("<h1>H <b>i</b></h1>") == "Hi" and X.markdown_title("x\n## B\n# A") == "A"
    assert X.chunks("A" * 5000) == [(0, 2500), (2000, 4500), (4000, 5000)]
    assert X.chunks("A" * 2300) == [(0, 2300)] == X.chunks("A" * 2500)[:0] + [(0, 2300)] and X.chunks("A" * 4500) == [(0, 2500), (2000, 4500), (4000, 4500)] and X.chunks("") == [(0, 0)]
    for bad in ("none", "{broken", "[1, 2"):
        with pytest.raises(ValueError):
            X.first_json(bad)
    assert X.first_json('so: {"a": [1]} end') == {"a": [1]} == X.first_json('```json\n{"a": [1]}\n```')
    df = spark.createDataFrame([("d", "# T\nWe model the élan as given. The labour market clears."), ("e", None)], "doc_id string, full_text string")
    got = {(r.name, r.raw_type) for r in X.entity_mentions(X.sections_of(df)).collect()}
    assert ("élan", "concept") in got and ("labour", "market") in got


def test_code_entities(spark):
    src = "def _phase_a():\n    pass\nclass N(nn.Module):\n    pass\nsmooth_x = 1\n"
    df = spark.createDataFrame([("r", "a.py", src), ("r", "bad.py", "def ("), ("r", "c.py", None)], "repo string, path string, source string")
    pats = [{"pattern": p, "entity_type": t} for p, t in (("def _phase_*", "phase"), ("class *(*nn.*)", "theory"), ("smooth_* =", "parameter"), ("odd", "none"))]
    assert {(r.symbol, r.line, r.entity_type) for r in X.code_entities(df, pats).collect()} == {("_phase_a", 1, "phase"), ("N", 3, "theory"), ("smooth_x", 5, "parameter")}
    more = spark.createDataFrame([("r", "a.py", "obj.smooth_a = 1\nsmooth_b[0] = 2\nsmooth_c, smooth_d = 1, 2\nsmooth_e = smooth_f = 3\n")], "repo string, path string, source string")
    assert {r.symbol for r in X.code_entities(more, pats).collect()} == {"smooth_e", "smooth_f"}


def test_first_seen(spark):
    e = spark.createDataFrame([("a", 1), ("b", 3)], "name string, line_no int")
    r = spark.createDataFrame([("a", "b", 2), ("a", "b", 3), ("a", "z", 9)], "source string, target string, line_no int")
    assert [x.line_no for x in X.first_seen_relations(e, r).collect()] == [3]


def test_memory_round_trip_and_exports(spark, tmp_path):
    e = spark.createDataFrame([("A b", "x", ["o"] * 12), ("C", "y", None)], "name string, entity_type string, observations array<string>")
    r = spark.createDataFrame([("A b", "C", "feeds_into")], "source string, target string, relation_type string")
    path = str(tmp_path / "m")
    S.memory_lines(e, r, "test").unionByName(S.memory_lines(e, r, "other")).write.text(path)
    ents, rels = S.read_memory(spark, path, "test")
    assert {(x.name, len(x.observations)) for x in ents.collect()} == {("A b", 10), ("C", 0)}
    assert [tuple(x) for x in rels.collect()] == [("A b", "C", "feeds_into")]
    assert S.write_memory(e, r, "", path) == 3 and S.read_memory(spark, path, "")[0].count() == 6
    assert S.read_memory(spark, str(tmp_path / "nowhere"), "test")[0].count() == 0
    assert "    A_b -->|feeds_into| C" in [x.value for x in S.mermaid_lines(e, r).collect()]
    odd = e.unionByName(spark.createDataFrame([("<&>", None, ["p", "q"])], e.schema))
    path = str(tmp_path / "g.graphml")
    S.write_lines(S.graphml_lines(odd, r), path)
    import xml.etree.ElementTree as ET

    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(path).getroot()
    assert {k.get("id") for k in root.iter(f"{ns}key")} == {"entity_type", "observations", "relation_type"}
    node = next(n for n in root.iter(f"{ns}node") if n.get("id") == "<&>")
    assert [(x.get("key"), x.text) for x in node] == [("observations", "p;q")]
    path = str(tmp_path / "g.jsonld")
    S.write_lines(S.jsonld_lines(odd, r), path)
    j = json.loads(open(path).read())
    assert len(j["entities"]) == 3 and j["relations"][0]["relationType"] == "feeds_into" and "@context" in j


def test_graph_and_claim_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "g.json")
    open(path, "w").write(json.dumps({"schema_name": "x", "documents": ["d"], "entities": {"A": {"name": "A", "entity_type": "t", "code_anchors": [{"repo": "r", "path": "p", "line": 1}], "new": 1}, "B \"q\"": {"name": "B \"q\"", "entity_type": "t", "confidence": 0.5}},
                                      "relations": [{"source": "A", "target": "B \"q\"", "relation_type": "causes", "sign": "+"}, {"source": "A", "target": "A", "relation_type": "causes"}]}))
    e, r, d = S.read_graph(spark, path)
    rows = [(x.ord, x.name, x.confidence, x.abstract, list(x.aliases)) for x in e.orderBy("ord").collect()]
    assert rows == [(0, "A", 1.0, False, []), (1, 'B "q"', 0.5, False, [])]
    assert [(x.ord, x.sign, x.edge_class, x.weight) for x in r.orderBy("ord").collect()] == [(0, "+", "mechanism", 1.0), (1, "unknown", "mechanism", 1.0)]
    again = str(tmp_path / "again.json")
    S.write_lines(S.graph_lines(e, r, d, "x"), again)
    e2, r2, d2 = S.read_graph(spark, again)
    assert sorted(map(str, e.collect())) == sorted(map(str, e2.collect())) and sorted(map(str, r.collect())) == sorted(map(str, r2.collect())) and d2.collect()[0][0] == "d"
    twice = r.unionByName(r).withColumn("ord", F.lit(None).cast("bigint"))
    S.write_lines(S.graph_lines(e, twice), again)
    assert len(json.loads(open(again).read())["relations"]) == 4
    S.write_lines(S.graph_lines(e.limit(0), r.limit(0)), again)
    assert json.loads(open(again).read())["entities"] == {}
    path = str(tmp_path / "c.json")
    open(path, "w").write(json.dumps({"claims": {"i": {"id": "i", "source": "a", "target": "b", "confidence": 0.4, "mechanisms": [{"name": "m", "elasticity_range": [0.1, 0.2], "conditions": [{"variable": "v", "operator": ">", "threshold": "3"}]}]}}, "regime_context": {"v": "4"}}))
    c, regime = S.read_claims(spark, path)
    assert regime == {"v": "4"} and c.first().mechanisms[0].elasticity_range == [0.1, 0.2] and c.first().evidence_count == 1
    S.write_lines(S.claim_lines(c.unionByName(c.withColumn("ord", F.lit(7).cast("bigint")).withColumn("target", F.lit("z"))), regime), again)
    c2, regime2 = S.read_claims(spark, again)
    assert [(x.id, x.target) for x in c2.collect()] == [("i", "z")] and regime2 == regime and json.loads(open(again).read())["entities"] == ["a", "z"]


def test_citations_and_documents(spark, tmp_path):
    (tmp_path / "bib.json").write_text('{"A": "k1", "B": {"key": "k2", "pages": "3"}}')
    assert {tuple(r) for r in S.read_citations(spark, str(tmp_path / "bib.json")).collect()} == {("A", "k1", ""), ("B", "k2", "3")}
    (tmp_path / "bib.json").write_text('[{"name": "A", "key": "k1"}]')
    assert [tuple(r) for r in S.read_citations(spark, str(tmp_path / "bib.json")).collect()] == [("A", "k1", "")]
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "a.md").write_text("# Title\nbody one\n## Two\nbody two")
    (docs / "sub" / "b.html").write_text("<title>T</title><h2>H</h2><p>x</p>")
    (docs / "c.bin").write_text("plain")
    (docs / "d.txt").write_bytes(b"caf\xe9")
    got = {r.doc_id.rsplit("/", 1)[1]: r for r in D.read_documents(spark, str(docs)).collect()}
    assert {k: (r.title, len(r.sections)) for k, r in got.items()} == {"a.md": ("Title", 2), "b.html": ("T", 1), "d.txt": ("d", 1)}
    assert "c.bin" in {r.doc_id.rsplit("/", 1)[1] for r in D.read_documents(spark, str(docs), suffixes=()).collect()}
    assert D.sections_table(D.read_documents(spark, str(docs)), 8).count() == 2
    assert D.parse_document("x.pdf", b"..", lambda b: ["First line\nmore", " ", "last"])[:2] == ("First line", [("Page 1", 1, "First line\nmore", 1), ("Page 3", 1, "last", 3)])
    with pytest.raises(RuntimeError):
        D.parse_document("x.pdf", b"..")
    (docs / "pkg").mkdir()
    (docs / "pkg" / "m.py").write_text("def phase_x():\n    pass\n")
    (docs / "n.py").write_text("def phase_y():\n    pass\n")
    assert [(r.repo, r.path) for r in D.source_files(spark, str(docs), include=["pkg"]).collect()] == [("docs", "pkg/m.py")]
    assert [r.path for r in D.source_files(spark, str(docs), exclude=["pkg/"]).collect()] == ["n.py"]


def test_schemas(tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\nentity_types:\n  agent: who acts\n  market: {description: trade, subtypes: [Exchange]}\nrelation_types:\n  causes: {domain: [agent]}\nvalidation: {a: 1, b: 2}\nextraction_hints: {x: [p, q]}\n")
    (tmp_path / "child.yaml").write_text("name: child\nextends: base\nentity_types:\n  agent: replaced\nrelation_types:\n  relates_to: any\nvalidation: {b: 3}\nextraction_hints: {x: [q, r]}\n")
    s = load_schema("child", tmp_path)
    assert s.name == "child" and s.entity_types["agent"]["description"] == "replaced" and list(s.entity_types) == ["agent", "market"] and s.entity_types["agent"]["color"] == "#607D8B"
    assert s.validation == {"a": 1, "b": 3} and s.hints["x"] == ["p", "q", "r"] and s.hints["entity_signals"] == []
    assert s.allows("agent", "causes", "market") and not s.allows("market", "causes", "agent") and s.allows("x", "relates_to", "y") and not s.allows("x", "odd", "y")
    assert [s.entity_type_for(x) for x in ("Market", "exchange", "trade", "sector", "concept")] == ["market", "market", "market", "market", "agent"]
    assert s.nearest("agents") == "agent" and s.nearest("odd") == "agent" and s.nearest("relates", "relation_types") == "relates_to"
    (tmp_path / "loop.yaml").write_text("extends: [base, loop]\n")
    with pytest.raises(ValueError):
        load_schema("loop", tmp_path)
    with pytest.raises(FileNotFoundError):
        load_schema("nowhere", tmp_path)


def test_model_extraction(spark):
    schema = Schema("s", entity_types={"agent": {"description": "", "subtypes": []}, "market": {"description": "", "subtypes": []}}, relation_types={"causes": {"description": "", "domain": [], "range": []}})
    sec = spark.createDataFrame([("d", 1, "H", "A text that is long enough to count.", 2), ("d", 2, "H", "short", None)], "doc_id string, sec_no int, heading string, text string, page int")

    def client(messages):
        if "entities that" in messages[0]["content"]:
            return 'Here: {"entities": [{"name": " Bank ", "type": "agents", "passage": "p"}, {"name": "bank", "type": "market", "aliases": ["B"]}, {"name": "", "type": "agent"}, {"name": "Oil", "type": "odd"}]}'
        if "causal claim" in messages[0]["content"]:
            return '{"claims": [{"source": "a", "target": "b", "evidence_type": "odd", "direction": "sideways", "conditions": [{"variable": "v"}, {"operator": ">"}], "claim_text": "t"}, {"source": "a", "target": " a "}]}'
        return '{"relations": [{"source": "Bank", "target": "Oil", "type": "causing"}, {"source": "bank", "target": "Oil", "type": "causes"}, {"source": "Oil", "target": "Oil", "type": "causes"}]}'

    e, r = A.extract_with_model(sec, schema, client)
    assert sorted((x.name, x.entity_type, list(x.aliases), len(x.provenance)) for x in e.collect()) == [("Bank", "agent", ["B"], 2), ("Oil", "agent", [], 1)]
    assert [(x.source, x.target, x.relation_type, x.weight) for x in r.collect()] == [("Bank", "Oil", "causes", 0.8)]
    c = A.extract_claims(sec, client).collect()
    assert [(x.source, x.evidence_type, x.net_direction, x.claim_assertiveness, x.evidence_directness) for x in c] == [("a", "narrative", "ambiguous", "moderate", "cited")]
    assert c[0].mechanisms[0].direction == "sideways" and [x.operator for x in c[0].mechanisms[0].conditions] == ["regime_is"]
    assert A.extract_with_model(sec, schema, lambda m: "no json")[0].count() == 0
    assert json.loads(A.batch_prompts(sec, schema).first().value)["id"] == "d_0_chunk0"
    lines = spark.createDataFrame([(0, '{"id": "r1", "response": {"entities": [{"name": "A", "type": "agent"}], "relations": [{"source": "A", "target": "B", "type": "causes"}]}}'), (1, ""), (2, '{"id": "r2", "document": "doc", "response": {"entities": [{"name": "B", "type": "agent"}], "relations": [{"source": "A", "target": "B", "type": "causes"}]}}')], "line_no int, value string")
    e, r = A.batch_responses(lines, schema)
    assert {(x.name, x.provenance[0].document) for x in e.collect()} == {("A", "r1"), ("B", "doc")} and [x.line_no for x in r.collect()] == [2]
    one = A.manual_claim(spark, "x", "y", "m", note="n").first()
    assert (one.source, one.extracted_by, one.mechanisms[0].name) == ("x", "manual", "m")


def test_streaming_ingest(spark, tmp_path):
    new = lambda i, t: spark.createDataFrame([("d", i, "H", t, 1, None)], "doc_id string, sec_no int, heading string, text string, level int, page int")
    for i, t in ((1, "The labour market is here."), (2, "The labour market and the tax rule.")):
        new(i, t).write.mode("append").parquet(str(tmp_path / "in"))
        I.ingest(I.section_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.name, r.n_mentions) for r in I.current_entities(spark, str(tmp_path / "out")).collect()} >= {("labour", 2)}


def test_command_line(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\nentity_types: {concept: c, market: m, rule: r}\nrelation_types: {causes: c}\nvalidation: {groundedness_target: 0.9}\nextraction_hints: {ast_patterns: [{pattern: 'def labour*', entity_type: market}]}\n")
    doc, repo, out = tmp_path / "doc.md", tmp_path / "repo", str(tmp_path / "g.json")
    doc.write_text("# T\nThe labour market is here. The tax rule is there, and labour causes tax.")
    repo.mkdir()
    (repo / "a.py").write_text("def labour():\n    pass\n")
    schema = ["--schema", str(tmp_path / "base.yaml")]
    run = lambda *a: cli.main(list(a), spark)
    assert run("ingest", str(doc), *schema, "-o", out) == 0
    assert {"labour", "tax"} <= set(json.loads(open(out).read())["entities"])
    assert run("ingest", str(doc), *schema, "--dual-extract") == 1
    assert run("merge", out, out, "-o", str(tmp_path / "m.json")) == 0 and set(json.loads((tmp_path / "m.json").read_text())["entities"]) == set(json.loads(open(out).read())["entities"])
    assert run("quality", out, *schema) == 1 and run("quality", out, *schema, "--allow-gate-failure") == 0
    assert run("ground", "--kg", out, "--ast-repo", str(repo), *schema, "--in-place") == 0
    assert json.loads(open(out).read())["entities"]["labour"]["code_anchors"][0]["symbol"] == "labour"
    assert run("export", out, "-f", "mermaid") == 0 and run("diff", "--old", str(tmp_path / "m.json"), "--new", out, "--report", str(tmp_path / "d.md")) == 0
    assert run("causal", "add", "--source", "a", "--target", "b", "--mechanism", "m", "-o", str(tmp_path / "c.json")) == 0
    assert run("causal", "add", "--source", "a", "--target", "c", "--mechanism", "m", "-o", str(tmp_path / "c.json")) == 0
    assert len(json.loads((tmp_path / "c.json").read_text())["claims"]) == 2


def test_relation_mentions_and_schema(spark):
    sec = spark.createDataFrame([("d", 1, "The Shock causes the loss, as ever. The loss feeds into the loss. A stranger triggers the Shock."), ("d", 2, None)], "doc_id string, sec_no int, text string")
    ents = spark.createDataFrame([("d", "shock"), ("d", "Loss"), ("x", "stranger")], "doc_id string, name string")
    assert [(r.source, r.target, r.relation_type) for r in X.relation_mentions(sec, ents).collect()] == [("shock", "Loss", "causes")]
    rel = spark.createDataFrame([(1, "a", "b", "causes"), (2, "b", "a", "causes"), (3, "a", "zz", "causes"), (4, "a", "b", "odd"), (5, "b", "a", "free")], "ord long, source string, target string, relation_type string")
    e = spark.createDataFrame([(1, "a", "agent"), (2, "b", "market")], "ord long, name string, entity_type string")
    rules = spark.createDataFrame([("causes", ["agent"], []), ("free", [], [])], "relation_type string, domain array<string>, range array<string>")
    assert {(r.ord, r.problem) for r in X.schema_violations(rel, e, rules).collect()} == {(2, "domain"), (4, "type")}

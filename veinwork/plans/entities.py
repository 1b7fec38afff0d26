"""Queries on resolution, agreement, extraction, conditions and horizons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.functions import causal as C
from veinwork.operators import agree, extract, resolve
from veinwork.operators import graph as G
from veinwork.operators import quality as Q
from veinwork.plans.graphs import ent, joined, rel
from veinwork.session import table
from veinwork.sources.schemas import Schema

#: Types that each relation type of the example schema may join; an empty list leaves a side free.
RULES = {
    "feeds_into": ([], []), "causes": (["mechanism", "shock", "agent"], []), "constrains": (["constraint", "parameter"], []), "amplifies": (["mechanism"], ["mechanism", "market", "shock"]),
    "propagates_losses_to": (["agent", "market"], ["agent", "market"]), "measures": (["state_variable", "parameter"], []), "implements": ([], ["theory"]), "triggers": (["shock"], []), "clears": (["market"], []),
}
#: Values of the variables that conditions ask for.
REGIME = {"leverage": "4.5", "policy_rate": "85%"}
EXAMPLE = Schema(
    "example", entity_types={t: {"description": d, "subtypes": s, "color": ""} for t, d, s in (("theory", "a body of ideas", ["school"]), ("mechanism", "how one thing moves another", []), ("agent", "who acts", []), ("state_variable", "a measured quantity", []), ("market", "where things are traded", []))},
    relation_types={t: {"description": "", "domain": a, "range": b} for t, (a, b) in RULES.items()},
)


def schema_violations(s, d):
    return extract.schema_violations(rel(s, d), ent(s, d), EXAMPLE.rules(s))


def first_seen_relations(s, d):
    names = ent(s, d).select("name", F.col("ord").alias("line_no"))
    return extract.first_seen_relations(names, rel(s, d).withColumn("line_no", F.col("ord"))).select("ord", "source", "target")


def orphan_rate(s, d):
    e, r = ent(s, d), rel(s, d)
    total = e.filter(~F.coalesce("abstract", F.lit(False))).agg(F.count_distinct("name").alias("total"))
    return Q.orphans(e, r).agg(F.count("name").alias("orphans")).join(F.broadcast(total)).withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("orphans") / F.col("total")).otherwise(0.0), 6))


def _sides(s, d):
    r = rel(s, d).filter("relation_type IS NOT NULL")
    return r.filter("edge_class = 'mechanism'"), r.filter("edge_class = 'structural'")


_KEYS = ["source", "target", "relation_type"]


def agreed_relations(s, d):
    a, b = _sides(s, d)
    return a.join(b, _KEYS, "left_semi").groupBy(*_KEYS).agg(F.min("ord").alias("ord"))


def one_sided_relations(s, d):
    a, b = _sides(s, d)
    return a.join(b, _KEYS, "left_anti").select("ord", F.lit("mechanism").alias("side")).unionByName(b.join(a, _KEYS, "left_anti").select("ord", F.lit("structural").alias("side")))


def cross_sign_conflicts(s, d):
    a, b = (x.filter("sign IN ('+', '-')").select(*_KEYS, F.col("ord").alias(f"ord_{n}"), F.col("sign").alias(f"sign_{n}")) for n, x in zip("ab", _sides(s, d)))
    return a.join(b, _KEYS).filter("sign_a <> sign_b").select("ord_a", "ord_b")


def name_blocking_pairs(s, d):
    return resolve.name_blocking_pairs(ent(s, d))


def fuzzy_resolve_lev(s, d):
    return resolve.edited_pairs(ent(s, d))


def fuzzy_resolve_ratio(s, d):
    names = ent(s, d).select(F.lower("name").alias("name"))
    return resolve.similar_names(names, names).filter("a < b").select("a", "b", F.round("score", 6).alias("score"))


def resolve_greedy(s, d):
    out, _ = resolve.resolve_entities(ent(s, d))
    return out.select("ord", "name", "entity_type", "n_records", joined("aliases").alias("aliases"))


def resolved_relations(s, d):
    _, renames = resolve.resolve_entities(ent(s, d))
    return resolve.resolve_relations(rel(s, d), renames).select("source", "target", "relation_type", "ord")


def _extractions(s, d):
    e, r = ent(s, d), rel(s, d)
    text_rel, code_rel = r.filter("edge_class <> 'structural'"), r.filter("edge_class = 'structural'")
    return agree.merge_extractions(e.filter("extracted_by = 'llm'"), text_rel, e.filter("extracted_by = 'ast'"), code_rel)


def merge_extractions(s, d):
    out = None
    for bucket, df in _extractions(s, d).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(bucket).alias("bucket"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def agreed_entities(s, d):
    return _extractions(s, d)["agreement_entities"]


def coverage(s, d):
    e = ent(s, d)
    return agree.covered(e.filter("extracted_by = 'ast'"), e.filter("extracted_by = 'llm'")).withColumn("ratio", F.round("ratio", 6))


def grounded_entities(s, d):
    e = ent(s, d)
    code = e.filter("extracted_by = 'ast' AND size(code_anchors) > 0")
    return agree.grounded(e.filter("extracted_by = 'llm'"), code).select("ord", F.size("code_anchors").alias("n_anchors"))


def md_sections(s, d):
    docs = table(s, d, "parsed_documents").select("doc_id", "full_text")
    return extract.sections_of(docs, "markdown").select("doc_id", "sec_no", "heading", "level", F.length("text").alias("n_chars"))


def html_sections(s, d):
    docs = table(s, d, "parsed_documents").filter("source_path LIKE '%.html'").select("doc_id", "full_text")
    return extract.sections_of(docs, "html").select("doc_id", "sec_no", "heading", "level", F.length("text").alias("n_chars"))


def chunks(s, d):
    docs = table(s, d, "parsed_documents").select("doc_id", F.lit(0).alias("sec_no"), F.col("full_text").alias("text"))
    return extract.chunk_rows(docs).select("doc_id", "chunk_no", "char_start", F.length("text").alias("n_chars"))


def section_lengths(s, d):
    sec = table(s, d, "sections").filter(F.length(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) >= 20)
    return sec.select("doc_id", "sec_no").distinct()


def regex_entities(s, d):
    return extract.entity_mentions(table(s, d, "sections").dropDuplicates(["doc_id", "sec_no"]).select("doc_id", "sec_no", "text")).groupBy("raw_type").agg(F.count("*").alias("n"))


def document_entities(s, d):
    sec = table(s, d, "sections").dropDuplicates(["doc_id", "sec_no"])
    return extract.document_entities(extract.entity_mentions(sec), EXAMPLE).select("doc_id", "name", "entity_type", F.size("provenance").alias("n_mentions"), "ord")


def graph_summary(s, d):
    r = table(s, d, "relations").filter("edge_class = 'identity' AND relation_type = 'implements'")
    return G.summary(r, ent(s, d))


def cascade_depth(s, d):
    r = rel(s, d).filter("relation_type = 'clears' AND edge_class = 'identity'")
    return s.createDataFrame([(G.cascade_depth(r),)], "depth int")


def _claims(s, d):
    return table(s, d, "claims").dropDuplicates(["ord"])


def temporal_gate(s, d):
    status = F.when(F.col("reversibility") == "permanent", "reversed").when(F.col("reversibility") == "unknown", "unknown").otherwise("kept")
    c = _claims(s, d).filter("confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)")
    return c.select("ord", F.round(C.temporal_gate(status, F.col("causal_type"), F.col("confidence")), 6).alias("confidence"), C.temporal_strength(status, F.col("causal_type"), F.col("confidence"), F.col("strength")).alias("strength"))


def claim_validity(s, d):
    return _claims(s, d).select("ord", C.external_validity(F.col("geographic_scope"), F.col("geographic_entities"), country="varlenemoor", decade="1990", economy="oecd").alias("validity"))


def _conditions(s, d):
    m = _claims(s, d).select("ord", F.posexplode("mechanisms").alias("pos", "m"))
    return m.select("ord", "pos", F.posexplode("m.conditions").alias("cpos", "c"))


def condition_eval(s, d):
    regime = F.create_map(*[F.lit(x) for kv in REGIME.items() for x in kv])
    c = F.col("c")
    return _conditions(s, d).select("ord", "pos", "cpos", F.coalesce(C.condition_met(c.operator, c.threshold, F.element_at(regime, c.variable)), F.lit(True)).alias("met"))


QUERIES = {
    f.__name__: f
    for f in (schema_violations, first_seen_relations, orphan_rate, agreed_relations, one_sided_relations, cross_sign_conflicts, name_blocking_pairs, fuzzy_resolve_lev, fuzzy_resolve_ratio, resolve_greedy,
              resolved_relations, merge_extractions, agreed_entities, coverage, grounded_entities, md_sections, html_sections, chunks, section_lengths, regex_entities, document_entities, graph_summary, cascade_depth, temporal_gate, claim_validity, condition_eval)
}

_R = "r AS (SELECT * FROM relations WHERE source IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord) = 1)"
_C = "c AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY ord) = 1)"
_RULES = ", ".join(f"('{t}', {a!r}::VARCHAR[], {b!r}::VARCHAR[])" for t, (a, b) in RULES.items())
_AB = "a AS (SELECT * FROM r WHERE edge_class = 'mechanism' AND relation_type IS NOT NULL), b AS (SELECT * FROM r WHERE edge_class = 'structural' AND relation_type IS NOT NULL)"
_BLOCK = """n AS (SELECT DISTINCT lower(name) AS name, entity_type FROM entities WHERE name IS NOT NULL),
k AS (SELECT DISTINCT name, entity_type, unnest(list_transform(string_split(name, ' '), lambda w: left(w, 3))) AS w FROM n),
p AS (SELECT DISTINCT x.name AS a, y.name AS b, x.entity_type FROM k x JOIN k y USING (entity_type, w) WHERE w <> '' AND x.name < y.name AND 2 * least(length(x.name), length(y.name)) >= 0.85 * (length(x.name) + length(y.name)))"""
_NUM = r"TRY_CAST(regexp_replace(trim({x}), '%+$', '') AS DOUBLE)"
_V = "CASE c.variable " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIME.items()) + " END"


def met_sql(value: str) -> str:
    """Whether condition c holds for a value."""
    n, t = _NUM.format(x=value), _NUM.format(x="c.threshold")
    lo, hi = (_NUM.format(x=f"string_split(c.threshold, '-')[{i}]") for i in (1, 2))
    return f"""coalesce(CASE WHEN {value} IS NULL THEN true WHEN c.operator = 'regime_is' THEN lower({value}) = lower(c.threshold) WHEN c.operator = '==' THEN {value} = c.threshold
WHEN {n} IS NULL THEN {value} = c.threshold WHEN c.operator = 'in_range' THEN CASE WHEN len(string_split(c.threshold, '-')) <> 2 OR {lo} IS NULL OR {hi} IS NULL THEN true ELSE {n} BETWEEN {lo} AND {hi} END
WHEN {t} IS NULL THEN true WHEN c.operator = '>' THEN {n} > {t} WHEN c.operator = '<' THEN {n} < {t} WHEN c.operator = '>=' THEN {n} >= {t} WHEN c.operator = '<=' THEN {n} <= {t} ELSE true END, true)"""


#: White space at the ends of a text, and where a window that begins at s ends.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(12288)"
_END = "CASE WHEN {s} + 2500 < n AND n > 2500 AND strpos(reverse(substring(x, {s} + 1, 2500)), '.') BETWEEN 1 AND 1249 THEN {s} + 2501 - strpos(reverse(substring(x, {s} + 1, 2500)), '.') WHEN n <= 2500 THEN n ELSE {s} + 2500 END"
_STATUS = "CASE reversibility WHEN 'permanent' THEN 'reversed' WHEN 'unknown' THEN 'unknown' ELSE 'kept' END"
_CLASS = "CASE WHEN {x} < 0.35 THEN 'correlation' WHEN {x} < 0.65 THEN 'weak_causal' ELSE 'strong_causal' END"
SQL = {
    "schema_violations": f"WITH {_R}, rules(relation_type, domain, range) AS (VALUES {_RULES}), t AS (SELECT name, arg_min(entity_type, ord) AS t FROM entities GROUP BY name), j AS (SELECT r.ord, CASE WHEN rules.relation_type IS NULL THEN 'type' WHEN len(domain) > 0 AND s.t IS NOT NULL AND NOT list_contains(domain, s.t) THEN 'domain' WHEN len(range) > 0 AND g.t IS NOT NULL AND NOT list_contains(range, g.t) THEN 'range' END AS problem FROM r LEFT JOIN rules USING (relation_type) LEFT JOIN t s ON s.name = r.source LEFT JOIN t g ON g.name = r.target) SELECT * FROM j WHERE problem IS NOT NULL",
    "first_seen_relations": f"WITH {_R}, seen AS (SELECT name, min(ord) AS o FROM entities GROUP BY name) SELECT r.ord, source, target FROM r JOIN seen a ON a.name = source JOIN seen b ON b.name = target WHERE a.o <= r.ord AND b.o <= r.ord",
    "orphan_rate": f"WITH {_R}, e AS (SELECT DISTINCT name FROM entities WHERE NOT coalesce(abstract, false)), o AS (SELECT name FROM e WHERE name NOT IN (SELECT source FROM r UNION SELECT target FROM r)) SELECT (SELECT count(name) FROM o) AS orphans, (SELECT count(name) FROM e) AS total, round(CASE WHEN (SELECT count(name) FROM e) = 0 THEN 0 ELSE (SELECT count(name) FROM o) / (SELECT count(name) FROM e) END, 6) AS ratio",
    "agreed_relations": f"WITH {_R}, {_AB} SELECT source, target, relation_type, min(ord) AS ord FROM a SEMI JOIN b USING (source, target, relation_type) GROUP BY 1, 2, 3",
    "one_sided_relations": f"WITH {_R}, {_AB} SELECT ord, 'mechanism' AS side FROM a ANTI JOIN b USING (source, target, relation_type) UNION ALL SELECT ord, 'structural' FROM b ANTI JOIN a USING (source, target, relation_type)",
    "cross_sign_conflicts": f"WITH {_R}, {_AB} SELECT a.ord AS ord_a, b.ord AS ord_b FROM a JOIN b USING (source, target, relation_type) WHERE a.sign IN ('+', '-') AND b.sign IN ('+', '-') AND a.sign <> b.sign",
    "name_blocking_pairs": f"WITH {_BLOCK} SELECT * FROM p",
    "fuzzy_resolve_lev": f"WITH {_BLOCK} SELECT * FROM p WHERE levenshtein(a, b) <= 0.15 * greatest(length(a), length(b))",
    "chunks": f"""WITH RECURSIVE t AS (SELECT doc_id, full_text AS x, length(full_text) AS n FROM parsed_documents WHERE length(trim(full_text, {_WHITE})) >= 20),
w AS (SELECT doc_id, x, n, 0 AS k, 0 AS s, {_END.format(s='0')} AS e FROM t UNION ALL SELECT doc_id, x, n, k + 1, e - 500, {_END.format(s='(e - 500)')} FROM w WHERE n > 2500 AND e - 500 < n)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS char_start, CAST(least(e, n) - s AS INTEGER) AS n_chars FROM w""",
    "md_sections": rf"""WITH l AS (SELECT doc_id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) AS i FROM parsed_documents WHERE full_text IS NOT NULL),
h AS (SELECT *, regexp_full_match(line, '#{{1,6}}\s+.+') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
b AS (SELECT doc_id, sec, coalesce(max(trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1), {_WHITE})) FILTER (head), 'Introduction') AS heading, coalesce(max(length(regexp_extract(line, '^(#{{1,6}})\s', 1))) FILTER (head), 1) AS level,
length(trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ''), {_WHITE})) AS n_chars FROM g GROUP BY doc_id, sec)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS INTEGER) AS sec_no, heading, CAST(level AS INTEGER) AS level, CAST(n_chars AS INTEGER) AS n_chars FROM b WHERE n_chars > 0""",
    "graph_summary": """WITH RECURSIVE c AS (SELECT source, target, arg_max(relation_type, ord) AS rt FROM relations WHERE source IS NOT NULL AND target IS NOT NULL AND edge_class = 'identity' AND relation_type = 'implements' GROUP BY 1, 2),
n AS (SELECT source AS name FROM c UNION SELECT target FROM c UNION SELECT name FROM entities WHERE name IS NOT NULL), e AS (SELECT source AS a, target AS b FROM c UNION SELECT target, source FROM c),
cc(name, component) USING KEY (name) AS (SELECT name, name FROM n UNION (SELECT u.name, min(v.component) FROM recurring.cc u JOIN e ON e.a = u.name JOIN cc v ON v.name = e.b WHERE v.component < u.component GROUP BY u.name)),
w AS (SELECT source AS start, target AS cur, [source, target] AS path FROM c WHERE source <= target UNION ALL SELECT start, c.target, list_append(path, c.target) FROM w JOIN c ON c.source = cur WHERE cur <> start AND c.target >= start AND (c.target = start OR NOT list_contains(path, c.target)))
SELECT 'n_entities' AS metric, count(*) AS value FROM n UNION ALL SELECT 'n_relations', count(*) FROM c UNION ALL SELECT 'n_components', count(DISTINCT component) FROM cc UNION ALL SELECT 'n_cycles', count(*) FROM w WHERE cur = start
UNION ALL SELECT 'entity_type:' || coalesce(entity_type, 'null'), count(DISTINCT name) FROM entities GROUP BY entity_type UNION ALL SELECT 'relation_type:' || coalesce(rt, 'null'), count(*) FROM c GROUP BY rt""",
    "section_lengths": r"SELECT DISTINCT doc_id, sec_no FROM sections WHERE length(trim(text, E' \t\n\r')) >= 20",
    "temporal_gate": f"WITH {_C}, v AS (SELECT *, {_STATUS} AS status FROM c WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)) SELECT ord, round(CASE WHEN status = 'reversed' THEN least(confidence, 0.33) WHEN status = 'unknown' AND causal_type = 'macro_statistical' THEN confidence * 0.7 ELSE confidence END, 6) AS confidence, CASE WHEN status = 'reversed' THEN 'correlation' WHEN status = 'unknown' AND causal_type = 'macro_statistical' THEN {_CLASS.format(x='(confidence * 0.7)')} ELSE strength END AS strength FROM v",
    "claim_validity": f"WITH {_C} SELECT ord, CAST(CASE WHEN coalesce(list_bool_or(list_transform(geographic_entities, lambda p: lower(p) = 'varlenemoor')), false) THEN 1.0 WHEN lower(coalesce(geographic_scope, '')) IN ('global', 'oecd') THEN CASE WHEN contains(lower(geographic_scope), 'oecd') THEN 0.7 ELSE 0.5 END ELSE 0.4 END AS DOUBLE) AS validity FROM c",
    "condition_eval": f"WITH {_C}, m AS (SELECT ord, unnest(mechanisms) AS m, generate_subscripts(mechanisms, 1) - 1 AS pos FROM c), x AS (SELECT ord, pos, unnest(m.conditions) AS c, generate_subscripts(m.conditions, 1) - 1 AS cpos FROM m) SELECT ord, CAST(pos AS INTEGER) AS pos, CAST(cpos AS INTEGER) AS cpos, {met_sql(_V)} AS met FROM x",
    "cascade_depth": f"WITH RECURSIVE {_R}, e AS (SELECT DISTINCT source AS s, target AS t FROM r WHERE relation_type = 'clears' AND edge_class = 'identity'), w AS (SELECT t, 1 AS n, [s, t] AS path FROM e UNION ALL SELECT e.t, n + 1, list_append(path, e.t) FROM w JOIN e ON e.s = w.t WHERE NOT list_contains(path, e.t)) SELECT CAST(coalesce(max(n), 0) AS INTEGER) AS depth FROM w",
}

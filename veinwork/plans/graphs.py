"""Queries on the knowledge graph and the event transition graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.functions.names import claim_id, entity_id
from veinwork.operators import graph as G
from veinwork.operators import quality as Q
from veinwork.session import table


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, weight): how often one kind of event follows another of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    return e.filter("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("weight"))


def rel(spark: SparkSession, d: str) -> DataFrame:
    return G.proper(table(spark, d, "relations"))


def ent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities")


def joined(c):
    return F.array_join(c, "|")


def transition_edges(s, d):
    return transitions(s, d)


def degree_centrality(s, d):
    return G.degree_centrality(transitions(s, d)).withColumn("centrality", F.round("centrality", 6))


def degree_topk(s, d):
    c = G.degree_centrality(G.collapsed_edges(table(s, d, "relations")))
    return c.orderBy(F.desc("degree"), "name").limit(15).select("name", "degree")


def entity_type_counts(s, d):
    return ent(s, d).groupBy("entity_type").agg(F.count("*").alias("n"))


def relation_type_counts(s, d):
    return G.collapsed_edges(table(s, d, "relations")).groupBy("relation_type").agg(F.count("*").alias("n"))


def merged_entities(s, d):
    return G.merged_entities(ent(s, d)).select("name", "entity_type", joined("aliases").alias("aliases"), joined("observations").alias("observations"), "n_records")


def dedup_entities(s, d):
    return G.deduplicated_entities(ent(s, d)).select("name", "entity_type", joined("aliases").alias("aliases"), "n_records")


def replaced_entities(s, d):
    return G.replaced_entities(ent(s, d)).select("name", "entity_type", "ord")


def collapsed_edges(s, d):
    return G.collapsed_edges(table(s, d, "relations"))


def known_relations(s, d):
    return G.known_relations(rel(s, d), ent(s, d)).select("ord", "source", "target")


def relation_dedupe(s, d):
    return G.first_relations(rel(s, d)).select("source", "target", "relation_type", "ord")


def relation_renames(s, d):
    pairs = ent(s, d).groupBy(F.lower("name").alias("l")).agg(F.min_by("name", "ord").alias("new"), F.collect_set("name").alias("olds")).select(F.explode("olds").alias("old"), "new")
    return G.renamed_relations(rel(s, d), pairs.filter("old <> new")).select("source", "target", "relation_type", "ord")


def neighbors_both(s, d):
    return G.neighbours(rel(s, d), "Food Web", "both")


def neighbors_out(s, d):
    return G.neighbours(rel(s, d), "Food Web", "out")


def neighbors_in(s, d):
    return G.neighbours(rel(s, d), "Food Web", "in")


def induced_subgraph(s, d):
    return G.induced_subgraph(rel(s, d), ent(s, d).filter("entity_type = 'mechanism'")).select("ord", "source", "target")


def khop_subgraph(s, d):
    return G.k_hop(rel(s, d), "Food Web", 2)


def graph_components(s, d):
    return G.components(rel(s, d)).groupBy("component").agg(F.count("*").alias("n"))


def simple_cycles(s, d):
    return G.simple_cycles(transitions(s, d)).select("length", joined("path").alias("path"))


def chains_topk(s, d):
    return G.chains(transitions(s, d)).select("n_nodes", joined("path").alias("path"))


def scc_count(s, d):
    return G.strong_components(rel(s, d).filter("lag = 'within_step'")).groupBy("scc").agg(F.count("*").alias("n"))


def orphans(s, d):
    return Q.orphans(ent(s, d), rel(s, d))


def groundedness_by_type(s, d):
    return Q.groundedness(ent(s, d)).drop("all_types").withColumn("ratio", F.round("ratio", 6))


def signedness(s, d):
    return Q.signedness(rel(s, d)).withColumn("ratio", F.round("ratio", 6))


def consistency(s, d):
    return Q.consistency(rel(s, d)).withColumn("ratio", F.round("ratio", 6))


def sign_conflict_pairs(s, d):
    r = rel(s, d).filter("sign IN ('+', '-')")
    a, b = (r.select("source", "target", "relation_type", F.col("ord").alias(f"ord_{x}"), F.col("sign").alias(f"sign_{x}")) for x in "ab")
    return a.join(b, ["source", "target", "relation_type"]).filter("sign_a = '+' AND sign_b = '-'").select("ord_a", "ord_b")


def graph_diff(s, d):
    r, e = rel(s, d), G.replaced_entities(ent(s, d))
    old_e = G.replaced_entities(ent(s, d).filter("loaded_at < TIMESTAMP_NTZ '2024-09-01 00:00:00'"))
    return G.graph_diff(old_e, e, r.filter("loaded_at < TIMESTAMP_NTZ '2024-09-01 00:00:00'"), r)


def falsify_buckets(s, d):
    r = rel(s, d)
    sim = r.filter("sign IN ('+', '-')").groupBy("source", "target").agg(F.min_by("sign", "ord").alias("sim_sign"))
    return Q.falsify(r, sim).groupBy("sign", "sim_sign", "verdict").agg(F.count("*").alias("n"))


def entity_ids(s, d):
    return ent(s, d).select("ord", entity_id(F.col("name")).alias("id"))


def claim_ids(s, d):
    c = table(s, d, "claims").dropDuplicates(["ord"])
    args = [F.coalesce(x, F.lit("")) for x in ("source", "target", "evidence_type", "claim_text")]
    return c.select("ord", claim_id(*args).alias("new_id"))


def entity_table(s, d):
    """Records of two types whose name holds 'credit', with counts and degree."""
    deg = G.degree_centrality(G.collapsed_edges(table(s, d, "relations"))).select("name", "degree")
    e = ent(s, d).filter("entity_type IN ('mechanism', 'market') AND lower(name) LIKE '%credit%'")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return e.join(deg, "name", "left").select("ord", "name", size("observations").alias("n_observations"), size("provenance").alias("n_sources"), F.coalesce("degree", F.lit(0)).alias("degree"))


def relation_table(s, d):
    """Edges of two types, as a table with the types of their ends."""
    e = G.collapsed_edges(table(s, d, "relations")).filter("relation_type IN ('causes', 'amplifies')")
    t = G.replaced_entities(ent(s, d)).select("name", "entity_type")
    for end in ("source", "target"):
        e = e.join(t.select(F.col("name").alias(end), F.col("entity_type").alias(f"{end}_type")), end, "left")
    return e.select("source", "target", "relation_type", "source_type", "target_type")


def graph_counts(s, d):
    e = G.collapsed_edges(table(s, d, "relations"))
    n = G.node_set(e, ent(s, d)).agg(F.count("*").alias("n_entities"))
    return n.join(F.broadcast(e.agg(F.count("*").alias("n_relations"))))


def explorer_nodes(s, d):
    """Nodes of two types with the size they are drawn in, by their degree among each other."""
    keep = G.replaced_entities(ent(s, d)).filter("entity_type IN ('mechanism', 'market')").select("name")
    deg = G.degree_centrality(G.induced_subgraph(G.collapsed_edges(table(s, d, "relations")), keep)).select("name", "degree")
    return keep.join(deg, "name", "left").select("name", (20 + 5 * F.coalesce("degree", F.lit(0))).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (relation_table, graph_counts, explorer_nodes, transition_edges, degree_centrality, degree_topk, entity_type_counts, relation_type_counts, merged_entities, dedup_entities, replaced_entities, collapsed_edges,
              known_relations, relation_dedupe, relation_renames, neighbors_both, neighbors_out, neighbors_in, induced_subgraph, khop_subgraph, graph_components, simple_cycles,
              chains_topk, scc_count, orphans, groundedness_by_type, signedness, consistency, sign_conflict_pairs, graph_diff, falsify_buckets, entity_ids, claim_ids, entity_table)
}

_T = """t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
edges AS (SELECT source, target, count(*) AS weight FROM t WHERE target IS NOT NULL GROUP BY 1, 2)"""
_R = "r AS (SELECT * FROM relations WHERE source IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord) = 1)"
_C = "c AS (SELECT source, target, arg_max(struct_pack(rt := relation_type, w := weight), ord) AS l FROM relations WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2)"
_DEG = "deg AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM c UNION ALL SELECT target FROM c) GROUP BY 1)"
_ARR = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce({c}, []))))), '|'), '')"
_LAST = "SELECT name, arg_max(entity_type, ord) AS entity_type, max(ord) AS ord FROM entities {w} GROUP BY name"
_NEAR = {k: v.replace("ROOT", "'Food Web'") for k, v in {"both": "SELECT target AS name FROM r WHERE source = ROOT UNION SELECT source FROM r WHERE target = ROOT", "out": "SELECT DISTINCT target AS name FROM r WHERE source = ROOT", "in": "SELECT DISTINCT source AS name FROM r WHERE target = ROOT"}.items()}
_LE = "le AS (SELECT name, arg_max(entity_type, ord) AS t FROM entities GROUP BY name)"
SQL = {
    "relation_table": f"WITH {_C}, {_LE} SELECT source, target, l.rt AS relation_type, a.t AS source_type, b.t AS target_type FROM c LEFT JOIN le a ON a.name = source LEFT JOIN le b ON b.name = target WHERE l.rt IN ('causes', 'amplifies')",
    "graph_counts": f"WITH {_C}, n AS (SELECT source AS name FROM c UNION SELECT target FROM c UNION SELECT name FROM entities WHERE name IS NOT NULL) SELECT (SELECT count(*) FROM n) AS n_entities, (SELECT count(*) FROM c) AS n_relations",
    "explorer_nodes": f"WITH {_C}, {_LE}, k AS (SELECT name FROM le WHERE t IN ('mechanism', 'market')), e AS (SELECT source, target FROM c WHERE source IN (SELECT name FROM k) AND target IN (SELECT name FROM k)), deg AS (SELECT name, count(*) AS n FROM (SELECT source AS name FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT k.name, 20 + 5 * coalesce(n, 0) AS size FROM k LEFT JOIN deg USING (name)",
    "transition_edges": f"WITH {_T} SELECT * FROM edges",
    "degree_centrality": f"WITH {_T}, d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) SELECT name, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d",
    "degree_topk": f"WITH {_C}, {_DEG} SELECT name, degree FROM deg ORDER BY degree DESC, name LIMIT 15",
    "entity_type_counts": "SELECT entity_type, count(*) AS n FROM entities GROUP BY 1",
    "relation_type_counts": f"WITH {_C} SELECT l.rt AS relation_type, count(*) AS n FROM c GROUP BY 1",
    "merged_entities": f"SELECT name, arg_min(entity_type, ord) AS entity_type, {_ARR.format(c='aliases')} AS aliases, {_ARR.format(c='observations')} AS observations, count(*) AS n_records FROM entities GROUP BY name",
    "dedup_entities": f"SELECT arg_min(name, ord) AS name, arg_min(entity_type, ord) AS entity_type, {_ARR.format(c='aliases')} AS aliases, count(*) AS n_records FROM entities GROUP BY lower(name)",
    "replaced_entities": _LAST.format(w=""),
    "collapsed_edges": f"WITH {_C} SELECT source, target, l.rt AS relation_type, l.w AS weight FROM c",
    "known_relations": f"WITH {_R} SELECT ord, source, target FROM r WHERE source IN (SELECT name FROM entities) AND target IN (SELECT name FROM entities)",
    "relation_dedupe": f"WITH {_R} SELECT source, target, relation_type, min(ord) AS ord FROM r WHERE source <> target GROUP BY 1, 2, 3",
    "relation_renames": f"WITH {_R}, m AS (SELECT e.name AS old, g.new FROM (SELECT DISTINCT name FROM entities) e JOIN (SELECT lower(name) AS l, arg_min(name, ord) AS new FROM entities GROUP BY 1) g ON lower(e.name) = g.l), x AS (SELECT ord, relation_type, coalesce(a.new, source) AS source, coalesce(b.new, target) AS target FROM r LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target) SELECT source, target, relation_type, min(ord) AS ord FROM x WHERE source <> target GROUP BY 1, 2, 3",
    **{f"neighbors_{k}": f"WITH {_R} {v}" for k, v in _NEAR.items()},
    "induced_subgraph": f"WITH {_R} SELECT ord, source, target FROM r WHERE source IN (SELECT name FROM entities WHERE entity_type = 'mechanism') AND target IN (SELECT name FROM entities WHERE entity_type = 'mechanism')",
    "khop_subgraph": f"WITH RECURSIVE {_R}, e AS (SELECT source AS a, target AS b FROM r UNION SELECT target, source FROM r), w AS (SELECT 'Food Web' AS name, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN e ON a = name WHERE hops < 2) SELECT name, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY name",
    "simple_cycles": f"WITH RECURSIVE {_T}, w AS (SELECT source AS start, target AS cur, CASE WHEN source = target THEN [source, target] ELSE [source, target] END AS path FROM edges WHERE source <= target UNION ALL SELECT start, e.target, list_append(path, e.target) FROM w JOIN edges e ON e.source = cur WHERE cur <> start AND e.target >= start AND (e.target = start OR NOT list_contains(path, e.target))) SELECT CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '|') AS path FROM w WHERE cur = start",
    "chains_topk": f"WITH RECURSIVE {_T}, w AS (SELECT target AS cur, [source, target] AS path FROM edges WHERE source <> target UNION ALL SELECT e.target, list_append(path, e.target) FROM w JOIN edges e ON e.source = cur WHERE NOT list_contains(path, e.target)) SELECT CAST(len(path) AS INTEGER) AS n_nodes, array_to_string(path, '|') AS path FROM w WHERE len(path) >= 3 ORDER BY len(path) DESC, path LIMIT 20",
    "graph_components": f"WITH RECURSIVE {_R}, e AS (SELECT source AS a, target AS b FROM r UNION SELECT target, source FROM r), cc(name, component) USING KEY (name) AS (SELECT DISTINCT a, a FROM e UNION (SELECT u.name, min(v.component) FROM recurring.cc u JOIN e ON e.a = u.name JOIN cc v ON v.name = e.b WHERE v.component < u.component GROUP BY u.name)) SELECT component, count(*) AS n FROM cc GROUP BY 1",
    "scc_count": f"WITH RECURSIVE {_R}, e AS (SELECT DISTINCT source AS a, target AS b FROM r WHERE lag = 'within_step'), w AS (SELECT a AS x, b AS y FROM e UNION SELECT w.x, e.b FROM w JOIN e ON e.a = w.y), m AS (SELECT x AS name, min(y) AS scc FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE v.x = w.y AND v.y = w.x) GROUP BY x) SELECT scc, count(*) AS n FROM m GROUP BY 1",
    "orphans": f"WITH {_R} SELECT DISTINCT name FROM entities WHERE NOT coalesce(abstract, false) AND name NOT IN (SELECT source FROM r UNION SELECT target FROM r)",
    "groundedness_by_type": "WITH g AS (SELECT entity_type, coalesce(list_bool_or(list_transform(code_anchors, lambda a: coalesce(a.path, '') <> '' AND coalesce(a.repo, '') <> '')), false) OR coalesce(list_bool_or(list_transform(citation_anchors, lambda c: coalesce(c.key, '') <> '')), false) AS g FROM entities) SELECT entity_type, count(*) FILTER (g) AS grounded, count(*) AS total, round(count(*) FILTER (g) / count(*), 6) AS ratio FROM g GROUP BY GROUPING SETS ((), (entity_type))",
    "signedness": f"WITH {_R} SELECT count(*) FILTER (sign IN ('+', '-', '±', '0')) AS signed, count(*) AS total, round(count(*) FILTER (sign IN ('+', '-', '±', '0')) / count(*), 6) AS ratio FROM r WHERE edge_class = 'mechanism'",
    "consistency": f"WITH {_R}, p AS (SELECT count(*) AS n, count(*) FILTER (sign = '+') AS p, count(*) FILTER (sign = '-') AS m FROM r WHERE edge_class = 'mechanism' AND sign IN ('+', '-', '±', '0') GROUP BY source, target HAVING count(*) >= 2) SELECT count(*) AS examined, count(*) FILTER (p > 0 AND m > 0) AS conflicts, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(1 - count(*) FILTER (p > 0 AND m > 0) / count(*), 6) END AS ratio FROM p",
    "sign_conflict_pairs": f"WITH {_R} SELECT a.ord AS ord_a, b.ord AS ord_b FROM r a JOIN r b USING (source, target, relation_type) WHERE a.sign = '+' AND b.sign = '-'",
    "graph_diff": f"WITH {_R}, o AS ({_LAST.format(w=chr(87)+'HERE loaded_at < TIMESTAMP ' + chr(39) + '2024-09-01' + chr(39))}), n AS ({_LAST.format(w='')}), old_r AS (SELECT DISTINCT source, target, relation_type FROM r WHERE loaded_at < TIMESTAMP '2024-09-01'), new_r AS (SELECT DISTINCT source, target, relation_type FROM r) SELECT 'entity_added' AS change, n.name AS what FROM n ANTI JOIN o USING (name) UNION ALL SELECT 'type_changed', o.name || ': ' || o.entity_type || ' -> ' || n.entity_type FROM o JOIN n USING (name) WHERE o.entity_type <> n.entity_type UNION ALL SELECT 'relation_added', concat_ws(' | ', source, target, relation_type) FROM new_r n WHERE NOT EXISTS (SELECT 1 FROM old_r o WHERE o.source = n.source AND o.target = n.target AND o.relation_type IS NOT DISTINCT FROM n.relation_type)",
    "falsify_buckets": f"WITH {_R}, sim AS (SELECT source, target, arg_min(sign, ord) AS sim_sign FROM r WHERE sign IN ('+', '-') GROUP BY 1, 2), j AS (SELECT sign, coalesce(sim_sign, 'unknown') AS sim_sign FROM r LEFT JOIN sim USING (source, target) WHERE edge_class = 'mechanism' AND coalesce(sign, 'unknown') <> 'unknown') SELECT sign, sim_sign, CASE WHEN sim_sign = 'unknown' THEN 'unknown' WHEN sign = '±' THEN 'confirmed' WHEN (sign = '+' AND sim_sign = '-') OR (sign = '-' AND sim_sign = '+') THEN 'flipped' ELSE 'confirmed' END AS verdict, count(*) AS n FROM j GROUP BY ALL",
    "entity_ids": "SELECT ord, replace(lower(name), ' ', '_') || '_' || left(sha256(name), 8) AS id FROM entities",
    "claim_ids": "WITH c AS (SELECT ord, coalesce(source, '') AS s, coalesce(target, '') AS t, coalesce(evidence_type, '') AS e, coalesce(claim_text, '') AS x FROM claims QUALIFY row_number() OVER (PARTITION BY ord) = 1) SELECT ord, left(replace(lower(s || '_' || t), ' ', '_'), 40) || '_' || left(sha256(concat_ws('|', s, t, e, x)), 12) AS new_id FROM c",
    "entity_table": f"WITH {_C}, {_DEG} SELECT ord, name, coalesce(len(observations), 0) AS n_observations, coalesce(len(provenance), 0) AS n_sources, coalesce(degree, 0) AS degree FROM entities LEFT JOIN deg USING (name) WHERE entity_type IN ('mechanism', 'market') AND lower(name) LIKE '%credit%'",
}

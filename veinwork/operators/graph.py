"""Graph views and analytics over entity and relation tables.

Order of insertion is a column (ord). Rows delivered twice are the same row. Iterative
operators cut their lineage into the checkpoint folder in each round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.session import cut


def merged_entities(entities: DataFrame, key: str = "name") -> DataFrame:
    """One entity for each key: the first record's type and confidence, all aliases, observations, provenance and anchors, sorted.

    Items are put in rows of their own first, so that a name with a large part of all
    records is reduced to its distinct items before it is shuffled.
    """
    kinds = ["aliases", "observations", "provenance", "code_anchors", "citation_anchors"]
    lists = [c for c in kinds if c in entities.columns]
    confidence = F.col("confidence") if "confidence" in entities.columns else F.lit(1.0).alias("confidence")
    first = F.min_by(F.struct("name", "entity_type", confidence), "ord")
    heads = entities.groupBy(F.col(key).alias("k")).agg(first.alias("f"), F.count("*").alias("n_records"))
    out = heads.select("k", "f.name", "f.entity_type", "f.confidence", "n_records")
    for c in lists:
        items = entities.select(F.col(key).alias("k"), F.explode(c).alias("v")).filter("v IS NOT NULL")
        out = out.join(items.groupBy("k").agg(F.array_sort(F.collect_set("v")).alias(c)).withColumnRenamed("k", f"k_{c}"), F.col("k").eqNullSafe(F.col(f"k_{c}")), "left").drop(f"k_{c}")
        out = out.withColumn(c, F.coalesce(c, F.array().cast(entities.schema[c].dataType)))
    return out.select("name", "entity_type", "confidence", *lists, "n_records")


def deduplicated_entities(entities: DataFrame) -> DataFrame:
    """As merged_entities, by lower-case name whatever the type."""
    return merged_entities(entities.withColumn("lower_name", F.lower("name")), "lower_name")


def replaced_entities(entities: DataFrame) -> DataFrame:
    """The last record of each name stands for the entity."""
    return entities.groupBy("name").agg(F.max_by(F.struct("entity_type", "confidence", "ord"), "ord").alias("l")).select("name", "l.entity_type", "l.confidence", "l.ord")


def proper(relations: DataFrame) -> DataFrame:
    """Relations with both ends, each delivered row once."""
    return relations.filter("source IS NOT NULL AND target IS NOT NULL").dropDuplicates(["ord"])


def collapsed_edges(relations: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the last relation's type and weight."""
    last = F.max_by(F.struct("relation_type", "weight"), "ord")
    return relations.filter("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(last.alias("l")).select("source", "target", "l.relation_type", "l.weight")


def node_set(edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    return (ends if entities is None else ends.unionByName(entities.select("name"))).filter("name IS NOT NULL").distinct()


def known_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose both ends are entities."""
    names = entities.select("name").distinct()
    return relations.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")


def first_relations(relations: DataFrame) -> DataFrame:
    """The first relation of each (source, target, type); no self loops."""
    return (
        relations.filter("source <> target")
        .groupBy("source", "target", "relation_type")
        .agg(F.min_by(F.struct("ord", "weight", "sign"), "ord").alias("f"))
        .select("source", "target", "relation_type", "f.ord", "f.weight", "f.sign")
    )


def renamed_relations(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Ends replaced by renames (old, new) where there is one; self loops dropped; first of each key kept."""
    r = relations
    for end in ("source", "target"):
        to = renames.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"))
        r = r.join(to, end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    return first_relations(r)


def neighbours(edges: DataFrame, name: str, direction: str = "both") -> DataFrame:
    out = edges.filter(F.col("source") == name).select(F.col("target").alias("name"))
    into = edges.filter(F.col("target") == name).select(F.col("source").alias("name"))
    return (out if direction == "out" else into if direction == "in" else out.unionByName(into)).distinct()


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, degree, centrality): in plus out degree over n - 1; a graph of one node has centrality 1."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    counted = ends.groupBy("name").agg(F.count("*").alias("degree"))
    if nodes is not None:
        counted = nodes.select("name").distinct().join(counted, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    one_row = counted.agg(F.count("*").alias("n_nodes"))
    return counted.join(F.broadcast(one_row)).withColumn("centrality", F.when(F.col("n_nodes") > 1, F.col("degree") / (F.col("n_nodes") - 1)).otherwise(1.0)).drop("n_nodes")


def induced_subgraph(edges: DataFrame, names: DataFrame) -> DataFrame:
    keep = names.select("name").distinct()
    return edges.join(keep.withColumnRenamed("name", "source"), "source", "left_semi").join(keep.withColumnRenamed("name", "target"), "target", "left_semi")


def k_hop(edges: DataFrame, root: str, depth: int = 2, direction: str = "both") -> DataFrame:
    """(name, hops) of nodes within depth hops of root; ValueError if root has no edge and is no node."""
    if edges.filter((F.col("source") == root) | (F.col("target") == root)).limit(1).count() == 0:
        raise ValueError(f"unknown root {root!r}")
    fwd = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    step = fwd if direction == "out" else fwd.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = (fwd.unionByName(fwd.select(F.col("b").alias("a"), F.col("a").alias("b"))) if direction == "both" else step).distinct()
    seen = edges.sparkSession.createDataFrame([(root, 0)], "name string, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        reached = step.join(frontier, step.a == frontier.name, "left_semi").select(F.col("b").alias("name")).distinct()
        frontier = cut(reached.join(seen, "name", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, component): weakly connected components, labelled by their least name.

    Labels move along edges and jump to the label's label, so that long chains take few
    rounds; it goes on until no label changes.
    """
    both = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = node_set(edges, nodes)
    labels = cut(names.select("name", F.col("name").alias("component")))
    while True:
        least = both.join(labels, both.b == labels.name).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(least, labels.name == least.a, "left").select("name", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("name").alias("component"), F.col("component").alias("c2"))
        new = cut(new.join(jump, "component", "left").select("name", "was", F.least("component", F.coalesce("c2", "component")).alias("component")))
        labels = new.select("name", "component")
        if new.filter("component <> was").limit(1).count() == 0:
            return labels


def _walks(edges: DataFrame, depth: int) -> list[DataFrame]:
    """Simple paths of 1..depth edges as (start, cur, path), one table for each length."""
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    level = e.filter("s <> t").select(F.col("s").alias("start"), F.col("t").alias("cur"), F.array("s", "t").alias("path"))
    out = []
    for _ in range(depth):
        level = cut(level)
        out.append(level)
        if level.limit(1).count() == 0:
            break
        level = level.join(e, level.cur == e.s).filter(~F.array_contains("path", F.col("t"))).select("start", F.col("t").alias("cur"), F.array_append("path", F.col("t")).alias("path"))
    return out


def simple_cycles(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(length, path): simple directed cycles, each from its least node and back to it; of any length unless most_edges is given.

    Only edges within strong components can lie on a cycle, so paths grow along these alone.
    """
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    loops = e.filter("s = t").select(F.lit(1).alias("length"), F.array("s", "t").alias("path"))
    parts = strong_components(edges)
    inside = e.filter("s <> t").join(parts.select(F.col("name").alias("s"), F.col("scc").alias("a")), "s").join(parts.select(F.col("name").alias("t"), F.col("scc").alias("b")), "t")
    e = cut(inside.filter("a = b").select("s", "t"))
    found = loops
    level = e.filter("s < t").select(F.col("s").alias("start"), F.col("t").alias("cur"), F.array("s", "t").alias("path"))
    n = 2
    while most_edges is None or n <= most_edges:
        level = cut(level)
        if level.limit(1).count() == 0:
            break
        step = level.join(e, level.cur == e.s).filter("t >= start")
        found = found.unionByName(step.filter("t = start").select(F.lit(n).alias("length"), F.array_append("path", F.col("t")).alias("path")))
        level = step.filter(~F.array_contains("path", F.col("t"))).select("start", F.col("t").alias("cur"), F.array_append("path", F.col("t")).alias("path"))
        n += 1
    return found


def chains(edges: DataFrame, min_nodes: int = 3, most_edges: int = 10, top: int = 20) -> DataFrame:
    """The longest simple paths, at most top of them; ties by the path itself."""
    all_ = None
    for level in _walks(edges, most_edges):
        part = level.filter(F.size("path") >= min_nodes).select("path")
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.distinct().withColumn("n_nodes", F.size("path")).orderBy(F.desc("n_nodes"), "path").limit(top)


def cascade_depth(edges: DataFrame) -> int:
    """Longest path of an acyclic graph in edges; of a cyclic one the longest simple cycle; 0 without edges."""
    e = cut(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct())
    if e.limit(1).count() == 0:
        return 0
    # peel nodes without predecessor; each layer is one edge deeper
    left, size, depth = e, e.count(), 0
    while size:
        heads = left.select(F.col("s").alias("n")).distinct().join(left.select(F.col("t").alias("n")).distinct(), "n", "left_anti")
        kept = cut(left.join(heads, left.s == heads.n, "left_anti"))
        n = kept.count()
        if n == size:
            return simple_cycles(kept.select(F.col("s").alias("source"), F.col("t").alias("target"))).agg(F.max("length")).collect()[0][0]
        left, size, depth = kept, n, depth + 1
    return depth


def strong_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(name, scc): nodes of strongly connected components of two or more nodes, or with a self loop.

    Nodes that lie on no cycle are trimmed; then the least name that reaches a node and
    the least name that it reaches split the rest, until they agree. Each round ends at
    least one component; more rounds than most_rounds, if given, are a RuntimeError.
    """
    e = cut(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct())
    loops = e.filter("s = t").select(F.col("s").alias("name")).distinct()
    left = e.filter("s <> t")
    done, rounds = None, 0
    while True:
        left = _trimmed(left)
        if left.limit(1).count() == 0:
            break
        if rounds == most_rounds:
            raise RuntimeError("no fixed point")
        rounds += 1
        fwd, back = _spread_min(left, "s", "t"), _spread_min(left, "t", "s")
        same = fwd.withColumnRenamed("m", "f").join(back.withColumnRenamed("m", "b"), "n")
        part = cut(same.filter("f = b").select(F.col("n").alias("name"), F.col("f").alias("scc")))
        done = part if done is None else done.unionByName(part)
        colour = same.select("n", F.concat_ws("\u0001", "f", "b").alias("c"))
        done_names = part.select(F.col("name").alias("n"))
        left = (
            left.join(done_names.withColumnRenamed("n", "s"), "s", "left_anti").join(done_names.withColumnRenamed("n", "t"), "t", "left_anti")
            .join(colour.select(F.col("n").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("n").alias("t"), F.col("c").alias("ct")), "t")
            .filter("cs = ct").select("s", "t")
        )
        left = cut(left)
    if done is None:
        return loops.withColumn("scc", F.col("name"))
    return done.unionByName(loops.join(done, "name", "left_anti").withColumn("scc", F.col("name")))


def _trimmed(e: DataFrame) -> DataFrame:
    size = e.count()
    while True:
        ins, outs = e.select(F.col("t").alias("n")).distinct(), e.select(F.col("s").alias("n")).distinct()
        on = ins.join(outs, "n", "left_semi")
        e = cut(e.join(on.withColumnRenamed("n", "s"), "s", "left_semi").join(on.withColumnRenamed("n", "t"), "t", "left_semi").select("s", "t"))
        n = e.count()
        if n == size:
            return e
        size = n


def _spread_min(e: DataFrame, a: str, b: str) -> DataFrame:
    """(n, m): the least name from which n is reached along edges a -> b, n itself included.

    What reaches the least name that reaches n reaches n too, so labels also jump to the
    label of their label, and long paths take few rounds.
    """
    labels = cut(e.select(F.explode(F.array("s", "t")).alias("n")).distinct().select("n", F.col("n").alias("m")))
    while True:
        moved = e.join(labels, e[a] == labels.n).groupBy(F.col(b).alias("x")).agg(F.min("m").alias("v"))
        new = labels.join(moved, labels.n == moved.x, "left").select("n", F.col("m").alias("was"), F.least("m", F.coalesce("v", "m")).alias("m"))
        jump = labels.select(F.col("n").alias("m"), F.col("m").alias("m2"))
        new = cut(new.join(jump, "m", "left").select("n", "was", F.least("m", F.coalesce("m2", "m")).alias("m")))
        labels = new.select("n", "m")
        if new.filter("m <> was").limit(1).count() == 0:
            return labels


def summary(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(metric, value): nodes, edges, entities by type, edges by relation type, components and cycles of the collapsed graph."""
    e = cut(collapsed_edges(edges))
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one(node_set(e, entities), "n_entities"), one(e, "n_relations")]
    parts.append(entities.groupBy("entity_type").agg(F.count_distinct("name").alias("value")).select(F.concat(F.lit("entity_type:"), F.coalesce("entity_type", F.lit("null"))).alias("metric"), "value"))
    parts.append(e.groupBy("relation_type").agg(F.count("*").alias("value")).select(F.concat(F.lit("relation_type:"), F.coalesce("relation_type", F.lit("null"))).alias("metric"), "value"))
    parts.append(one(components(e, entities).select("component").distinct(), "n_components"))
    parts.append(one(simple_cycles(e), "n_cycles"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_set(documents: Sequence[DataFrame]) -> DataFrame:
    """(document): documents of several graphs, each once."""
    out = documents[0].select("document")
    for d in documents[1:]:
        out = out.unionByName(d.select("document"))
    return out.filter("document IS NOT NULL").distinct()


def entities_by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type)


def entity_named(entities: DataFrame, name: str) -> DataFrame:
    """The last record of a name; no row for an unknown one."""
    return replaced_entities(entities.filter(F.col("name") == name))


def graph_diff(old_entities: DataFrame, new_entities: DataFrame, old_rel: DataFrame, new_rel: DataFrame) -> DataFrame:
    """(change, what): entities and relations added, removed or of another type."""
    e = old_entities.select("name", F.col("entity_type").alias("old_type"), F.lit(True).alias("o")).join(
        new_entities.select("name", F.col("entity_type").alias("new_type"), F.lit(True).alias("n")), "name", "full_outer")
    change = F.when(F.col("o").isNull(), "entity_added").when(F.col("n").isNull(), "entity_removed").when(F.col("old_type") != F.col("new_type"), "type_changed")
    ents = e.select(change.alias("change"), F.when(change == "type_changed", F.concat_ws(": ", "name", F.concat_ws(" -> ", "old_type", "new_type"))).otherwise(F.col("name")).alias("what"))
    key: Sequence[str] = ("source", "target", "relation_type")
    r = old_rel.select(*key).distinct().withColumn("o", F.lit(True)).join(new_rel.select(*key).distinct().withColumn("n", F.lit(True)), list(key), "full_outer")
    rels = r.select(F.when(F.col("o").isNull(), "relation_added").when(F.col("n").isNull(), "relation_removed").alias("change"), F.concat_ws(" | ", *key).alias("what"))
    return ents.unionByName(rels).filter("change IS NOT NULL")

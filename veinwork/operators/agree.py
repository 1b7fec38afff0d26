"""Agreement of two extractions, of text and of code, and grounding of a graph in code.

Names are compared in the form of matcher_name. Candidate pairs come from the exact join
of similar_names; only pairs are then assigned one to one, in the order of the text
entities, within connected blocks.

Defined cases: entities without a name are left out; null types equal each other; a null
abstract is false; empty tables give empty buckets; other columns are kept where said.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions.names import matcher_name
from veinwork.operators.graph import components
from veinwork.operators.resolve import similar_names
from veinwork.session import tasks


def candidate_matches(text: DataFrame, code: DataFrame, threshold: float = 0.85, scored: DataFrame | None = None) -> DataFrame:
    """(text_ord, code_ord, name, abstract, same_type, score) of pairs that may be matched.

    scored takes the place of similar_names: (a, b, score) of normalised names by any other
    measure, with its own way of finding candidates.
    """
    t = text.filter("name IS NOT NULL").select(F.col("ord").alias("text_ord"), "name", F.col("entity_type").alias("tt"), F.coalesce("abstract", F.lit(False)).alias("abstract"), matcher_name(F.col("name")).alias("a"))
    c = code.filter("name IS NOT NULL").select(F.col("ord").alias("code_ord"), F.col("entity_type").alias("ct"), matcher_name(F.col("name")).alias("b"))
    if scored is None:
        scored = similar_names(t.select(F.col("a").alias("name")), c.select(F.col("b").alias("name")), threshold)
    return (
        scored.filter(F.col("score") >= threshold).join(t, "a").join(c, "b").withColumn("same_type", F.col("tt").eqNullSafe(F.col("ct")))
        .filter("same_type OR abstract").select("text_ord", "code_ord", "name", "abstract", "same_type", "score")
    )


def assign(pairs: list[tuple[int, int, str, bool, bool, float]]) -> list[tuple[int, int, str]]:
    """(text_ord, code_ord, 'same' or 'implements'): each text entity in order takes its best unused partner, the first of equals.

    Entities of one type are matched first; then abstract ones that have no partner under
    their name take one of any type.
    """
    by_text: dict[int, list] = {}
    for t, c, name, abstract, same, score in pairs:
        by_text.setdefault(t, []).append((-score, c, name, abstract, same))
    used: set[int] = set()
    matched: set[str] = set()
    out = []
    for kind in ("same", "implements"):
        before = set(matched)
        for t in sorted(by_text):
            name, abstract = by_text[t][0][2:4]
            if kind == "implements" and (not abstract or name in before):
                continue
            free = sorted((s, c) for s, c, _, _, same in by_text[t] if c not in used and (same or kind == "implements"))
            if free:
                used.add(free[0][1])
                matched.add(name)
                out.append((t, free[0][1], kind))
    return out


def matched_entities(text: DataFrame, code: DataFrame, threshold: float = 0.85, most_pairs: int = 200_000, scored: DataFrame | None = None) -> DataFrame:
    """(text_ord, code_ord, kind): the one-to-one assignment; a block of more than most_pairs pairs is a ValueError."""
    pairs = candidate_matches(text, code, threshold, scored).persist(StorageLevel.MEMORY_AND_DISK)
    # what may compete: a text entity with its partners, and text entities of one name
    ends = pairs.select(F.concat(F.lit("t"), "name").alias("source"), F.concat(F.lit("c"), F.col("code_ord").cast("string")).alias("target")).distinct()
    blocks = components(ends)
    placed = pairs.join(blocks.withColumnRenamed("name", "node"), F.concat(F.lit("t"), "name") == F.col("node")).drop("node")
    large = placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most_pairs).limit(1).collect()
    if large:
        raise ValueError(f"a block of {large[0]['n']} pairs of names")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["text_ord", "code_ord", "name", "abstract", "same_type", "score"]].itertuples(index=False, name=None))
        return pd.DataFrame(assign(rows), columns=["text_ord", "code_ord", "kind"])

    # nothing competes with another block, so many blocks are assigned at once
    bucket = F.pmod(F.xxhash64("component"), F.lit(tasks(placed)))
    return placed.groupBy(bucket.alias("bucket")).applyInPandas(run, "text_ord bigint, code_ord bigint, kind string")


def merge_extractions(text: DataFrame, text_relations: DataFrame, code: DataFrame, code_relations: DataFrame, threshold: float = 0.85, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """The buckets of both extractions: agreement, text_only and code_only of entities and relations, and sign_conflicts.

    Agreed entities of one type bear the name of the code entity and both ords; an
    abstract text entity bound to code stays beside it, with an 'implements' relation.
    """
    links = matched_entities(text, code, threshold, scored=scored).persist(StorageLevel.MEMORY_AND_DISK)
    t = text.select(F.col("ord").alias("text_ord"), F.col("name").alias("text_name"), F.col("entity_type").alias("text_type"))
    c = code.select(F.col("ord").alias("code_ord"), F.col("name").alias("code_name"), F.col("entity_type").alias("code_type"))
    pairs = links.join(t, "text_ord").join(c, "code_ord").persist(StorageLevel.MEMORY_AND_DISK)
    null = F.lit(None).cast("bigint")
    same = pairs.filter("kind = 'same'").select(F.col("code_name").alias("name"), F.col("code_type").alias("entity_type"), "text_ord", "code_ord")
    bound = pairs.filter("kind = 'implements'")
    agreed = same.unionByName(bound.select(F.col("text_name").alias("name"), F.col("text_type").alias("entity_type"), "text_ord", null.alias("code_ord"))).unionByName(
        bound.select(F.col("code_name").alias("name"), F.col("code_type").alias("entity_type"), null.alias("text_ord"), "code_ord"))
    # an unmatched text entity is out of every bucket if its name was matched elsewhere
    text_only = text.join(pairs.select(F.col("text_name").alias("name")).distinct(), "name", "left_anti")
    code_only = code.join(links.select(F.col("code_ord").alias("ord")), "ord", "left_anti")
    new_of = F.when(F.col("kind") == "same", F.col("code_name")).otherwise(F.col("text_name"))
    text_map = pairs.groupBy(F.col("text_name").alias("old")).agg(F.max_by(new_of, F.struct(F.col("kind") == "implements", "text_ord")).alias("new"))
    names = agreed.select("name").distinct()

    def keyed(r: DataFrame, renames: DataFrame | None) -> DataFrame:
        for end, k in (("source", "s"), ("target", "t")):
            if renames is None:
                r = r.withColumn(k, F.col(end))
            else:
                r = r.join(renames.select(F.col("old").alias(f"o{k}"), F.col("new").alias(f"n{k}")), F.col(end) == F.col(f"o{k}"), "left").withColumn(k, F.coalesce(f"n{k}", end)).drop(f"o{k}", f"n{k}")
        return r

    tr, cr = keyed(text_relations, text_map), keyed(code_relations, None)
    key = ["s", "t", "relation_type"]
    both = tr.select(*key).distinct().join(cr.select(*key).distinct(), key, "left_semi")
    both = both.join(names.withColumnRenamed("name", "s"), "s", "left_semi").join(names.withColumnRenamed("name", "t"), "t", "left_semi").select(*key).persist(StorageLevel.MEMORY_AND_DISK)
    first = tr.join(both, key, "left_semi").groupBy(*key).agg(F.min("ord").alias("ord"))
    implements = bound.select(F.col("text_name").alias("source"), F.col("code_name").alias("target"), F.lit("implements").alias("relation_type"), null.alias("ord"))
    signs = lambda r, n: r.filter("sign IN ('+', '-')").select(*key, F.col("ord").alias(f"{n}_ord"), F.col("sign").alias(f"{n}_sign"))
    return {
        "agreement_entities": agreed, "text_only_entities": text_only, "code_only_entities": code_only,
        "agreement_relations": first.select(F.col("s").alias("source"), F.col("t").alias("target"), "relation_type", "ord").unionByName(implements),
        "text_only_relations": tr.join(both, key, "left_anti").drop("s", "t"), "code_only_relations": cr.join(both, key, "left_anti").drop("s", "t"),
        "sign_conflicts": signs(tr, "text").join(signs(cr, "code"), key).join(both, key, "left_semi").filter("text_sign <> code_sign").select("text_ord", "code_ord", "text_sign", "code_sign"),
    }


def covered(code: DataFrame, names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(matched, total, ratio): code entities whose name is in the graph or resembles one there; ratio 1 without code entities."""
    fuzzy = similar_names(code.select(matcher_name(F.col("name")).alias("name")), names.select(matcher_name(F.col("name")).alias("name")), threshold).select(F.col("a").alias("k")).distinct().withColumn("near", F.lit(True))
    exact = names.select(F.col("name")).distinct().withColumn("hit", F.lit(True))
    rows = code.select("name", matcher_name(F.col("name")).alias("k")).join(exact, "name", "left").join(fuzzy, "k", "left")
    return rows.agg(F.count_if(F.coalesce("hit", "near").isNotNull()).alias("matched"), F.count("*").alias("total")).withColumn("ratio", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(1.0))


def grounded(entities: DataFrame, code: DataFrame, citations: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """Entities with the anchors of the code symbol of their name, or else of the first similar one, and the citations of their name.

    code has ord, name and code_anchors; citations name, key and pages. Anchors that are
    there already are not repeated.
    """
    anchors = code.select(F.col("name").alias("symbol"), "ord", F.explode("code_anchors").alias("v"))
    first = code.groupBy(F.col("name").alias("symbol")).agg(F.min("ord").alias("at"))
    symbols = first.select("symbol", "at", matcher_name(F.col("symbol")).alias("b"))
    names = entities.select("name").filter("name IS NOT NULL").distinct()
    exact = names.join(symbols, names.name == symbols.symbol).select("name", "symbol")
    rest = names.join(exact, "name", "left_anti").select("name", matcher_name(F.col("name")).alias("a"))
    near = similar_names(rest.select(F.col("a").alias("name")), symbols.select(F.col("b").alias("name")), threshold)
    fuzzy = near.join(rest, "a").join(symbols, "b").groupBy("name").agg(F.min_by("symbol", "at").alias("symbol"))
    found = exact.unionByName(fuzzy).join(anchors, "symbol").groupBy("name").agg(F.array_sort(F.collect_set("v")).alias("new_code"))
    out = entities.join(found, "name", "left").withColumn("code_anchors", F.array_union(F.coalesce("code_anchors", F.array().cast(entities.schema["code_anchors"].dataType)), F.coalesce("new_code", F.array().cast(entities.schema["code_anchors"].dataType)))).drop("new_code")
    if citations is not None:
        kind = entities.schema["citation_anchors"].dataType
        cited = citations.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("key", F.coalesce("pages", F.lit("")).alias("pages")))).alias("new_cited"))
        out = out.join(cited, "name", "left").withColumn("citation_anchors", F.array_union(F.coalesce("citation_anchors", F.array().cast(kind)), F.coalesce("new_cited", F.array().cast(kind)))).drop("new_cited")
    return out

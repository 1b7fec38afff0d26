"""Quality metrics, gates and falsification of a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.graph import strong_components

SIGNED = ["+", "-", "±", "0"]


def is_grounded() -> Column:
    """A code anchor with repo and path, or a citation with a key."""
    code = F.exists(F.coalesce("code_anchors", F.array().cast("array<struct<repo:string,path:string,line:int,symbol:string>>")), lambda a: (F.coalesce(a.path, F.lit("")) != "") & (F.coalesce(a.repo, F.lit("")) != ""))
    cited = F.exists(F.coalesce("citation_anchors", F.array().cast("array<struct<key:string,pages:string>>")), lambda c: F.coalesce(c.key, F.lit("")) != "")
    return code | cited


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(1.0)).otherwise(num / den)


def groundedness(entities: DataFrame, require_for: list[str] | None = None, allow_abstract: list[str] | None = None) -> DataFrame:
    """(entity_type, grounded, total, ratio, all_types), with a row for all types; abstract entities of allowed types are left out."""
    scope = entities.filter(F.col("entity_type").isin(require_for)) if require_for else entities
    if allow_abstract:
        scope = scope.filter(~(F.coalesce("abstract", F.lit(False)) & F.col("entity_type").isin(allow_abstract)))
    g = scope.select("entity_type", is_grounded().alias("g"))
    return g.groupingSets([[], [F.col("entity_type")]], F.col("entity_type")).agg(
        F.count_if("g").alias("grounded"), F.count("*").alias("total"), (F.grouping("entity_type") == 1).alias("all_types")
    ).withColumn("ratio", _ratio(F.col("grounded"), F.col("total")))


def mechanism(relations: DataFrame) -> DataFrame:
    return relations.filter("edge_class = 'mechanism'")


def signedness(relations: DataFrame) -> DataFrame:
    """(signed, total, ratio) over mechanism edges; 1 without edges."""
    return mechanism(relations).agg(F.count_if(F.col("sign").isin(SIGNED)).alias("signed"), F.count("*").alias("total")).withColumn("ratio", _ratio(F.col("signed"), F.col("total")))


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name): concrete entities at no end of any relation."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("name"))
    return entities.filter(~F.coalesce("abstract", F.lit(False))).select("name").distinct().join(ends, "name", "left_anti")


def consistency(relations: DataFrame) -> DataFrame:
    """(examined, conflicts, ratio): pairs with two or more signed mechanism edges, and those with both + and -."""
    pairs = mechanism(relations).filter(F.col("sign").isin(SIGNED)).groupBy("source", "target").agg(
        F.count("*").alias("n"), F.count_if(F.col("sign") == "+").alias("p"), F.count_if(F.col("sign") == "-").alias("m"))
    return pairs.filter("n >= 2").agg(F.count("*").alias("examined"), F.count_if((F.col("p") > 0) & (F.col("m") > 0)).alias("conflicts")).withColumn(
        "ratio", F.when(F.col("examined") == 0, 1.0).otherwise(1 - F.col("conflicts") / F.col("examined")))


def cycle_count(relations: DataFrame, lag: str) -> int:
    """Number of strongly connected components with a cycle over the edges of exactly this lag."""
    return strong_components(relations.filter(F.col("lag") == lag)).select("scc").distinct().count()


def quality_report(entities: DataFrame, relations: DataFrame, options: dict, code: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """(metric, value, n, target, passed): one row for each metric; passed is null where nothing is asked or nothing counted.

    n is what the value is a share of. Coverage is there with code entities only; orphan
    rate and consistency never fail.
    """
    from veinwork.operators.agree import covered

    metric = lambda df, name, n: df.select(F.lit(name).alias("metric"), F.col("ratio").cast("double").alias("value"), F.col(n).cast("bigint").alias("n"))
    g = groundedness(entities, options.get("require_grounding_for"), options.get("allow_abstract")).filter(F.col("all_types")).drop("all_types")
    concrete = entities.filter(~F.coalesce("abstract", F.lit(False))).agg(F.count_distinct("name").alias("total"))
    o = orphans(entities, relations).agg(F.count("name").alias("orphans")).join(F.broadcast(concrete)).withColumn("ratio", F.when(F.col("total") > 0, F.col("orphans") / F.col("total")).otherwise(0.0))
    out = metric(g, "groundedness", "total").unionByName(metric(signedness(relations), "signedness", "total")).unionByName(metric(consistency(relations), "consistency", "examined")).unionByName(metric(o, "orphan_rate", "total"))
    if code is not None:
        out = out.unionByName(metric(covered(code, entities, threshold), "coverage", "total"))
    target = F.lit(None).cast("double")
    for m in ("groundedness", "signedness", "coverage"):
        if options.get(f"{m}_target") is not None:
            target = F.when(F.col("metric") == m, float(options[f"{m}_target"])).otherwise(target)
    asked = F.col("target").isNotNull() & ((F.col("n") > 0) | (F.col("metric") == "coverage"))
    out = out.withColumn("target", target).withColumn("passed", F.when(asked, F.col("value") >= F.col("target")))
    for lag in ("within_step", "across_step"):
        k = cycle_count(relations, lag)
        forbidden = (options.get("cycle_policy") or {}).get(lag) == "forbid"
        row = entities.sparkSession.createDataFrame([(f"cycles_{lag}", float(k), None, 0.0 if forbidden else None, k == 0 if forbidden else None)], "metric string, value double, n bigint, target double, passed boolean")
        out = out.unionByName(row)
    return out


def simulated_signs(relations: DataFrame, adapter) -> DataFrame:
    """(source, target, sim_sign, sim_lag) of an adapter with edge_sign and edge_lag, asked once for each pair of ends."""
    def run(batches):
        for b in batches:
            yield b.assign(sim_sign=[adapter.edge_sign(s, t) for s, t in zip(b["source"], b["target"])], sim_lag=[adapter.edge_lag(s, t) if hasattr(adapter, "edge_lag") else None for s, t in zip(b["source"], b["target"])])

    return relations.select("source", "target").distinct().mapInPandas(run, "source string, target string, sim_sign string, sim_lag string")


def falsify(relations: DataFrame, simulated: DataFrame, subset: str = "mechanism") -> DataFrame:
    """(source, target, sign, sim_sign, verdict): confirmed, flipped or unknown against simulated (source, target, sim_sign)."""
    if subset not in ("mechanism", "all"):
        raise ValueError(f"unknown subset {subset!r}")
    edges = (mechanism(relations) if subset == "mechanism" else relations).filter("coalesce(sign, 'unknown') <> 'unknown'")
    sim = F.coalesce("sim_sign", F.lit("unknown"))
    verdict = (
        F.when(sim == "unknown", "unknown").when((F.col("sign") == "±") | (sim == "±"), "confirmed")
        .when(((F.col("sign") == "+") & (sim == "-")) | ((F.col("sign") == "-") & (sim == "+")), "flipped").otherwise("confirmed")
    )
    return edges.join(simulated, ["source", "target"], "left").select("ord", "source", "target", "sign", sim.alias("sim_sign"), verdict.alias("verdict"))

import random

import pytest

from veinwork.operators import graph as G
from veinwork.operators import quality as Q


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "source string, target string")


def test_cycles_of_complete_graph(spark):
    k5 = [(a, b) for a in "abcde" for b in "abcde"]
    assert G.simple_cycles(edges(spark, k5)).count() == 89


def test_chains_and_depth(spark):
    path = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")])
    assert G.chains(path).first().path == ["a", "b", "c", "d"]
    assert G.cascade_depth(path) == 3
    assert G.cascade_depth(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])) == 3
    assert G.cascade_depth(edges(spark, [])) == 0


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randint(0, 60):02d}", f"n{rnd.randint(0, 60):02d}") for _ in range(45)]
    got = {r.name: r.component for r in G.components(edges(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"), ("f", "a")])
    got = {r.name: r.scc for r in G.strong_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_unfinished_strong_components_are_an_error(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")])
    with pytest.raises(RuntimeError):
        G.strong_components(e, most_rounds=1)
    assert G.strong_components(e, most_rounds=2).count() == 4


def test_k_hop_and_unknown_root(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d")])
    assert {(r.name, r.hops) for r in G.k_hop(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        G.k_hop(e, "zz")


def test_loop_centrality(spark):
    loop = edges(spark, [("Firm", "Credit Market"), ("Credit Market", "Bank"), ("Bank", "Firm")])
    assert {r.centrality for r in G.degree_centrality(loop).collect()} == {1.0}


def test_merge_keeps_first_type_and_all_observations(spark):
    rows = [(1, "Firm", "agent", 1.0, ["CB"], ["x"]), (2, "Firm", "market", 0.5, None, ["y", "x"])]
    r = G.merged_entities(spark.createDataFrame(rows, "ord long, name string, entity_type string, confidence double, aliases array<string>, observations array<string>")).first()
    assert (r.entity_type, r.aliases, r.observations, r.n_records) == ("agent", ["CB"], ["x", "y"], 2)


def test_falsify(spark):
    signs = ["+", "-", "±", "unknown", None]
    rel = spark.createDataFrame([(i, f"s{i}", "t", s, "mechanism") for i, s in enumerate(signs)] + [(9, "s9", "t", "+", "identity")], "ord long, source string, target string, sign string, edge_class string")
    sim = spark.createDataFrame([("s0", "t", "-"), ("s1", "t", "-"), ("s2", "t", "+")], "source string, target string, sim_sign string")
    assert {r.ord: r.verdict for r in Q.falsify(rel, sim).collect()} == {0: "flipped", 1: "confirmed", 2: "confirmed"}
    assert {r.ord: r.verdict for r in Q.falsify(rel, sim, "all").collect()}[9] == "unknown"
    with pytest.raises(ValueError):
        Q.falsify(rel, sim, "some")


def test_cascade_fixtures(spark):
    from veinwork.operators.cascade import run_cascade, run_feedback

    mech = "struct<name:string,direction:string,time_lag_min:string,time_lag_max:string,conditions:array<struct<variable:string,operator:string,threshold:string,description:string,currently_met:boolean>>>"
    schema = f"ord long, source string, target string, confidence double, mechanisms array<{mech}>"
    m = lambda d="positive", lo="1 month", hi="3 months", cond=(): [("m", d, lo, hi, list(cond))]
    shock = spark.createDataFrame([("s", "A", "positive", {"leverage": "low"})], "shock_id string, entity string, direction string, regime_context map<string,string>")
    linear = spark.createDataFrame([(1, "A", "B", 0.9, m()), (2, "B", "C", 0.8, m(lo="2 months", hi="6 months")), (3, "C", "A", 0.9, m())], schema)
    got = {r.entity: r for r in run_cascade(linear, shock).collect()}
    assert round(got["B"].confidence, 4) == 0.9 and round(got["C"].confidence, 4) == 0.72
    assert (got["C"].time_horizon_min, got["C"].time_horizon_max) == ("3 months", "9 months")
    assert {r.entity for r in run_cascade(linear, shock, min_confidence=0.8).collect()} == {"A", "B"}
    conflict = spark.createDataFrame([(1, "A", "B", 0.8, m()), (2, "A", "C", 0.7, m("negative")), (3, "C", "B", 0.7, m())], schema)
    b = {r.entity: r for r in run_cascade(conflict, shock, min_confidence=0.1).collect()}["B"]
    assert (b.direction, b.n_incoming_channels, b.confidence) == ("conflicted", 2, 0.8)
    blocked = spark.createDataFrame([(1, "A", "B", 0.8, m(cond=[("leverage", "regime_is", "high", "", None)]))], schema)
    assert {r.entity for r in run_cascade(blocked, shock).collect()} == {"A"}
    fed = {r.entity: r.confidence for r in run_feedback(linear, shock).collect() if r.iteration == 0}
    assert fed["A"] == 1.0 and round(fed["B"], 4) == 0.9


def test_durations(spark):
    from pyspark.sql import functions as F

    from veinwork.functions.causal import add_time, duration_days

    rows = ["immediate", None, "5 days", "3 months", "2 quarters", "1 year", "junk"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    assert [r.d for r in df.select("i", duration_days(F.col("x")).alias("d")).orderBy("i").collect()] == [0, 0, 5, 90, 180, 365, 0]
    pairs = [("immediate", "3 months", "3 months"), ("1 month", "2 months", "3 months"), ("1 month", "immediate", "4 weeks"), ("1 year", "6 months", "1.5 years")]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select(add_time(F.col("a"), F.col("b")).alias("got"), "want").collect())

import random
from difflib import SequenceMatcher

import pytest

from veinwork.operators import agree, resolve
from veinwork.operators import graph as G

ENT = "ord long, name string, entity_type string, aliases array<string>, observations array<string>, abstract boolean, source string"


def made(spark, rows):
    return spark.createDataFrame([(o, n, t, a, ["o"], b, "clash") for o, n, t, a, b in rows], ENT)


def names(n, seed):
    rnd = random.Random(seed)
    heads = ["labour market", "tax wedge", "output gap", "money demand", "oil shock", "ab", "abc", "x", "labor market", "labour markets", "tax wedges", "money demands"]
    out = []
    for _ in range(n):
        w = list(rnd.choice(heads))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice("abcdeo _")
        out.append("".join(w) if rnd.random() < 0.8 else "".join(w).title())
    return out


def test_similar_names_lose_nothing(spark):
    a, b = sorted(set(names(120, 1))), sorted(set(names(120, 2)))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "name string")
    for t in (0.85, 0.6):
        want = {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= t}
        assert {(r.a, r.b) for r in resolve.similar_names(df(a), df(b), t, ranked=20).collect()} == want


def sequential(rows, t):
    """One pass over all records in order, without blocks."""
    kept, out = [], {}
    for o, name, kind, aliases, _ in rows:
        for k in kept:
            own = {x.lower() for x in aliases}
            if ((kind == k[2] and name.lower() == k[1].lower()) or name.lower() in k[3] or k[1].lower() in own
                    or (kind == k[2] and SequenceMatcher(None, name.lower(), k[1].lower()).ratio() >= t)):
                k[3] |= own | ({name.lower()} if name != k[1] else set())
                out[o] = k[0]
                break
        else:
            kept.append([o, name, kind, {x.lower() for x in aliases}])
            out[o] = o
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_equals_one_pass(spark, seed):
    rnd = random.Random(seed)
    pool = names(60, seed)
    rows, seen = [], set()
    for i, n in enumerate(pool):
        kind, aliases = rnd.choice(["a", "b"]), sorted(set(rnd.sample(pool, rnd.choice([0, 0, 1, 2]))))
        if (n, kind, tuple(aliases)) not in seen:
            seen.add((n, kind, tuple(aliases)))
            rows.append((i, n, kind, aliases, False))
    got = {r.ord: r.entity_ord for r in resolve.resolved_records(made(spark, rows)).collect()}
    assert got == sequential(rows, 0.85)


def test_resolved_entities_and_relations(spark):
    rows = [(1, "Labour Market", "m", ["LM"], False), (2, "labour market", "m", None, False), (3, "LM", "x", [], False), (4, "Tax", "m", None, True), (5, "Labour Market", "m", ["LM"], False), (6, None, "m", None, False)]
    out, renames = resolve.resolve_entities(made(spark, rows))
    assert {(r.name, r.n_records, tuple(r.aliases)) for r in out.collect()} == {("Labour Market", 4, ("LM", "labour market")), ("Tax", 1, ())}
    assert {(r.old, r.new) for r in renames.collect()} == {("labour market", "Labour Market"), ("LM", "Labour Market")}
    rel = spark.createDataFrame([(1, "LM", "Tax", "causes", 1.0, "+"), (2, "labour market", "Tax", "causes", 1.0, "-"), (3, "LM", "labour market", "causes", 1.0, "+")], "ord long, source string, target string, relation_type string, weight double, sign string")
    assert [(r.source, r.target, r.ord) for r in resolve.resolve_relations(rel, renames).collect()] == [("Labour Market", "Tax", 1)]
    e, r = resolve.merge_graphs([made(spark, rows[:1]), made(spark, rows[1:4])], [rel.limit(0), rel])
    assert {x.name for x in e.collect()} == {"Labour Market", "Tax"} and r.count() == 1
    assert resolve.resolve_entities(made(spark, []))[0].count() == 0
    with pytest.raises(ValueError):
        resolve.resolved_records(made(spark, rows), most_forms=1)


def assigned(text, code, t):
    """Both passes over all entities in order, without blocks."""
    norm = lambda x: x.lower().replace("_", " ").strip()
    used, done, out = set(), set(), set()
    for kind in ("same", "implements"):
        before = set(done)
        for o, n, ty, _, ab in text:
            if kind == "implements" and (n in before or not ab):
                continue
            best = None
            for p, m, tz, _, _ in code:
                s = SequenceMatcher(None, norm(n), norm(m)).ratio()
                if p in used or s < t or (ty != tz and not (kind == "implements" and ab)):
                    continue
                if best is None or s > best[0]:
                    best = (s, p)
            if best:
                used.add(best[1])
                done.add(n)
                out.add((o, best[1], kind))
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_matching_of_extractions(spark, seed):
    rnd = random.Random(seed)
    text = [(i, n, rnd.choice("ab"), None, rnd.random() < 0.4) for i, n in enumerate(names(40, seed))]
    code = [(i, n.replace(" ", "_"), rnd.choice("ab"), None, False) for i, n in enumerate(names(40, seed + 9))]
    got = {tuple(r) for r in agree.matched_entities(made(spark, text), made(spark, code)).collect()}
    assert got == assigned(text, code, 0.85)


def test_buckets_and_grounding(spark):
    text = made(spark, [(1, "Tax Wedge", "m", None, False), (2, "Output Gap", "t", None, True), (3, "Only Text", "m", None, False)])
    code = made(spark, [(1, "tax_wedge", "m", None, False), (2, "output_gap", "m", None, False), (3, "only_code_here", "m", None, False)])
    rel = "ord long, source string, target string, relation_type string, sign string"
    tr = spark.createDataFrame([(1, "Tax Wedge", "Output Gap", "causes", "+"), (2, "Tax Wedge", "Only Text", "causes", "+")], rel)
    cr = spark.createDataFrame([(1, "tax_wedge", "Output Gap", "causes", "-"), (2, "tax_wedge", "x", "causes", "+")], rel)
    out = agree.merge_extractions(text, tr, code, cr)
    assert {r.name for r in out["agreement_entities"].collect()} == {"tax_wedge", "Output Gap", "output_gap"}
    assert [r.name for r in out["text_only_entities"].collect()] == ["Only Text"] and [r.name for r in out["code_only_entities"].collect()] == ["only_code_here"]
    assert {(r.source, r.target, r.relation_type) for r in out["agreement_relations"].collect()} == {("tax_wedge", "Output Gap", "causes"), ("Output Gap", "output_gap", "implements")}
    assert [(r.text_ord, r.code_ord) for r in out["sign_conflicts"].collect()] == [(1, 1)]
    assert [r.ord for r in out["text_only_relations"].collect()] == [2] and [r.ord for r in out["code_only_relations"].collect()] == [2]
    c = agree.covered(code, text).first()
    assert (c.matched, c.total) == (2, 3) and agree.covered(code.limit(0), text).first().ratio == 1.0
    anchored = spark.createDataFrame([(1, "tax_wedge", [("r", "p", 1, "tax_wedge")])], "ord long, name string, code_anchors array<struct<repo:string,path:string,line:int,symbol:string>>")
    ents = spark.createDataFrame([("Tax Wedge", None, None), ("other", [("r", "q", 2, "s")], [])], "name string, code_anchors array<struct<repo:string,path:string,line:int,symbol:string>>, citation_anchors array<struct<key:string,pages:string>>")
    cited = spark.createDataFrame([("other", "k", None)], "name string, key string, pages string")
    assert {(r.name, len(r.code_anchors), len(r.citation_anchors)) for r in agree.grounded(ents, anchored, cited).collect()} == {("Tax Wedge", 1, 0), ("other", 1, 1)}


def test_graphs_beyond_old_bounds(spark):
    ring = spark.createDataFrame([(f"n{i:02d}", f"n{(i + 1) % 14:02d}") for i in range(14)], "source string, target string")
    assert [r.length for r in G.simple_cycles(ring).collect()] == [14] and G.cascade_depth(ring) == 14
    path = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(16)], "source string, target string")
    assert G.cascade_depth(path) == 16 and G.components(path).select("component").distinct().count() == 1


def test_feedback_merges_before_it_restarts(spark):
    from veinwork.operators.cascade import run_feedback

    mech = "struct<name:string,direction:string,time_lag_min:string,time_lag_max:string,conditions:array<struct<variable:string,operator:string,threshold:string,description:string,currently_met:boolean>>>"
    m = lambda d="positive": [("m", d, None, None, [])]
    claims = spark.createDataFrame([(1, "A", "B", 0.9, m()), (2, "A", "C", 0.9, m("negative")), (3, "B", "D", 0.9, m()), (4, "C", "D", 0.5, m())], f"ord long, source string, target string, confidence double, mechanisms array<{mech}>")
    shock = spark.createDataFrame([("s", "A", "positive", {})], "shock_id string, entity string, direction string, regime_context map<string,string>")
    rows = {(r.iteration, r.entity): r for r in run_feedback(claims, shock, min_confidence=0.1, max_depth=1, n_iterations=3, decay=0.5).collect()}
    # round 1: B says positive and C says negative of D, so D is conflicted after the merge and restarts nothing
    assert rows[1, "D"].direction == "conflicted" and rows[1, "D"].n_incoming_channels == 2 and rows[1, "D"].confidence == 0.45
    assert rows[0, "A"].direction == "positive" and dict(rows[1, "D"].incoming_directions) == {"positive": 1, "negative": 1}
    assert (2, "D") in rows and rows[2, "D"].confidence == 0.225 and (0, "D") not in rows
    general = run_feedback(claims, shock, regime={"v": "1"}).count()
    assert general > 0


def heap_cascade(edges, start, direction, least, deepest):
    """Effects by a queue on falling confidence, first come first; edges are (source, target, confidence, direction) in order."""
    import heapq

    effects, n, queue = {}, 0, [(-1.0, 0, start, [start], direction)]
    while queue:
        c, _, at, path, d = heapq.heappop(queue)
        if len(path) > deepest + 1:
            continue
        e = effects.setdefault(at, {"first": d, "path": path, "conf": -c, "dirs": {}, "paths": []})
        e["dirs"][d] = e["dirs"].get(d, 0) + 1
        e["paths"].append(path)
        for s, t, conf, edge in edges:
            if s == at and -c * conf >= least and t not in path:
                n += 1
                new = "ambiguous" if "ambiguous" in (d, edge) else "state_dependent" if "state_dependent" in (d, edge) else "positive" if d == edge else "negative"
                heapq.heappush(queue, (c * conf, n, t, [*path, t], new))
    return {
        at: ("conflicted" if len(set(e["dirs"]) - {"ambiguous", "state_dependent"}) > 1 else e["first"], round(e["conf"], 9), tuple(e["path"]), tuple(sorted(e["dirs"].items())), tuple(map(tuple, e["paths"])))
        for at, e in effects.items()
    }


def test_cascades_equal_a_queue(spark):
    from veinwork.operators.cascade import run_cascade

    mech = "struct<name:string,direction:string,time_lag_min:string,time_lag_max:string,conditions:array<struct<variable:string,operator:string,threshold:string,description:string,currently_met:boolean>>>"
    rnd, claims, shocks, want = random.Random(7), [], [], {}
    for g in range(40):  # graphs that don't touch, each with its own shock; equal confidences make ties
        edges = []
        for _ in range(rnd.randint(3, 12)):
            a, b = rnd.sample("uvwxyz", 2)
            edges.append((f"{g}{a}", f"{g}{b}", rnd.choice([0.5, 0.8, 0.8, 1.0]), rnd.choice(["positive", "negative", "negative", "ambiguous", "state_dependent"])))
        for s, t, c, d in edges:
            claims.append((len(claims) + 1, s, t, c, [("m", d, None, None, [])]))
        shocks.append((f"s{g}", f"{g}u", rnd.choice(["positive", "negative"]), {}))
        want |= {(f"s{g}", at): e for at, e in heap_cascade(edges, f"{g}u", shocks[-1][2], 0.2, 4).items()}
    df = spark.createDataFrame(claims, f"ord long, source string, target string, confidence double, mechanisms array<{mech}>")
    sh = spark.createDataFrame(shocks, "shock_id string, entity string, direction string, regime_context map<string,string>")
    got = {
        (r.shock_id, r.entity): (r.direction, round(r.confidence, 9), tuple(r.causal_path), tuple(sorted(r.incoming_directions.items())), tuple(map(tuple, r.all_paths)))
        for r in run_cascade(df, sh, 0.2, 4).collect()
    }
    assert got == want and len(got) > 80


def templates(n, seed):
    """Names made of few words, so that most pairs share many bigrams."""
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        w = list(f"{rnd.choice(['labour', 'credit', 'lagged', 'marine'])} {rnd.choice(['wage', 'supply', 'tariff', 'turnover'])} {rnd.choice(['rate', 'index', 'spiral'])} of {rnd.choice(['var', 'mor', 'jel'])}{rnd.choice(['stoe', 'jane', 'core'])}{rnd.choice(['port', 'gate', 'moor'])}")
        for _ in range(rnd.choice([0, 0, 1, 3])):
            w[rnd.randrange(len(w))] = rnd.choice("aeo é")
        out.add("".join(w))
    return sorted(out)


def test_ratios_of_many_pairs_equal_the_library():
    from veinwork.functions.matching import sequence_ratios

    rnd = random.Random(3)
    a = ["".join(rnd.choice("abc é\0\U0001f600") for _ in range(rnd.choice([0, 1, 5, 35, 70, 120, 210]))) for _ in range(600)]
    b = ["".join(c for c in x if rnd.random() < 0.9) if rnd.random() < 0.7 else rnd.choice(a) for x in a]
    assert sequence_ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


def test_names_of_shared_words(spark):
    from veinwork.functions.matching import bigram_bits, close_pairs, code_points, count_bits

    same = [n for n in templates(300, 1) if len(n) == 31]
    codes = code_points(same)
    block = codes, count_bits(codes, [(ord(c), k) for c in "aeiortl " for k in (1, 2, 3)]), bigram_bits(codes)
    y, x = close_pairs(block, block, 9)
    assert len(y) < 0.5 * len(same) ** 2 and {(i, j) for i, s in enumerate(same) for j, t in enumerate(same) if SequenceMatcher(None, s, t).ratio() >= 0.85} <= set(zip(y.tolist(), x.tolist()))
    a, b = templates(300, 1), [*templates(300, 2), "x" * 150, "x" * 140]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    near = lambda x, y: (m := SequenceMatcher(None, x, y)).real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and m.ratio() >= 0.85
    want = {(x, y) for x in a for y in b if near(x, y)}
    assert {(r.a, r.b) for r in resolve.similar_names(df(a), df(b)).collect()} == want and len(want) > 300


def test_agreement_of_names_of_shared_words(spark):
    text = [(i, n, "a", None, i % 3 == 0) for i, n in enumerate(templates(150, 4))]
    code = [(i, n.replace(" ", "_"), "ab"[i % 2], None, False) for i, n in enumerate(templates(150, 5))]
    got = {tuple(r) for r in agree.matched_entities(made(spark, text), made(spark, code)).collect()}
    assert got == assigned(text, code, 0.85) and {k for _, _, k in got} == {"same", "implements"}


def test_coverage_of_names_of_shared_words(spark):
    names, code = templates(150, 6), templates(150, 7)
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    want = sum(any(SequenceMatcher(None, c.strip(), n.strip()).ratio() >= 0.85 for n in names) for c in code)
    r = agree.covered(df(code), df(names)).first()
    assert (r.matched, r.total) == (want, 150) and 0 < want


def test_grounding_of_names_of_shared_words(spark):
    kind = "array<struct<repo:string,path:string,line:int,symbol:string>>"
    names, code = templates(150, 8), templates(150, 9)
    symbols = spark.createDataFrame([(i, c, [("r", "p", i, c)]) for i, c in enumerate(code)], f"ord long, name string, code_anchors {kind}")
    got = {r.name: [a.symbol for a in r.code_anchors] for r in agree.grounded(spark.createDataFrame([(n, None) for n in names], f"name string, code_anchors {kind}"), symbols).collect()}
    first = lambda n: [n] if n in code else [c for c in code if SequenceMatcher(None, n.strip(), c.strip()).ratio() >= 0.85][:1]
    assert got == {n: first(n) for n in names} and any(got.values())


def test_replay_asks_only_what_may_match():
    # one block of many records: before, each was compared with every entity
    n = 60_000
    rows = [(i, f"Name {i}", "k", [f"alias {i}"], [f"name {i - 1}"] if i % 3 == 2 else []) for i in range(n)]
    rows += [(n, "ALIAS 7", "other", [], []), (n + 1, "new", "other", ["name 4", "name 9"], ["name 1"])]
    got = dict(resolve.replay(rows))
    # 2 follows 1 by ratio, and so on; an alias is known whatever the type; an own alias that names an entity joins the first of these
    assert all(got[i] == (i - 1 if i % 3 == 2 else i) for i in range(n)) and got[n] == 7 and got[n + 1] == 4


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_edited_pairs_lose_none(spark):
    rnd = random.Random(11)
    rows = [(n, rnd.choice(["a", "b", None])) for n in [*templates(120, 10), *names(60, 10), "tax  wedge", ""]]
    keys = lambda n: {w[:3] for w in n.split(" ")} - {""}
    low = {(n.lower(), k) for n, k in rows if k}
    want = {(x, y, k) for x, k in low for y, m in low if k == m and x < y and keys(x) & keys(y) and 2 * min(len(x), len(y)) >= 0.85 * (len(x) + len(y)) and edit_distance(x, y) <= 0.15 * max(len(x), len(y))}
    assert {tuple(r) for r in resolve.edited_pairs(spark.createDataFrame(rows, "name string, entity_type string")).collect()} == want and len(want) > 10


def test_blocking_pairs_are_made_once_in_chunks(spark):
    rnd = random.Random(12)
    rows = [(n, rnd.choice(["a", "b", None])) for n in [*templates(120, 12), *names(60, 12), "tax  wedge", ""]]
    keys = lambda n: {w[:3] for w in n.split(" ")} - {""}
    low = {(n.lower(), k) for n, k in rows if k}
    want = sorted((x, y, k) for x, k in low for y, m in low if k == m and x < y and keys(x) & keys(y) and 2 * min(len(x), len(y)) >= 0.85 * (len(x) + len(y)))
    df = spark.createDataFrame(rows, "name string, entity_type string")
    assert all(sorted(tuple(r) for r in resolve.name_blocking_pairs(df, chunk=c).collect()) == want for c in (3, 500))


def test_cascades_without_horizons_are_the_same(spark):
    from veinwork.operators.cascade import run_cascade

    mech = "struct<name:string,direction:string,time_lag_min:string,time_lag_max:string,conditions:array<struct<variable:string,operator:string,threshold:string,description:string,currently_met:boolean>>>"
    m = [("m", "negative", "2 weeks", "1 year", [])]
    claims = spark.createDataFrame([(1, "A", "B", 0.9, m), (2, "B", "C", 0.8, m), (3, "A", "C", 0.5, m)], f"ord long, source string, target string, confidence double, mechanisms array<{mech}>")
    shock = spark.createDataFrame([("s", "A", "positive", {})], "shock_id string, entity string, direction string, regime_context map<string,string>")
    cols = ["entity", "direction", "confidence", "causal_path", "n_incoming_channels", "incoming_directions", "all_paths", "time_horizon_min"]
    with_, without = ({r.entity: tuple(r) for r in run_cascade(claims, shock, horizons=h).select(*cols).collect()} for h in (True, False))
    assert {k: v[:-1] for k, v in with_.items()} == {k: v[:-1] for k, v in without.items()} and len(with_) == 3
    assert with_["B"][-1] == "2 weeks" and not any(v[-1] for v in without.values())

import datetime as dt
import itertools
import random

import pytest

from veinwork.llm import mixing, names, subjects, survivors

T = dt.datetime
ENT = "ord long, name string, entity_type string, aliases array<string>, observations array<string>, provenance array<struct<document:string,section:string,page:int,passage:string,char_offset:int>>, code_anchors array<struct<repo:string,path:string,line:int,symbol:string>>, confidence double, extracted_by string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, trust string"


def ent(spark, rows):
    return spark.createDataFrame([(o, n, t, None, obs, None, None, c, by, at, gone, "clash") for o, n, t, obs, c, by, at, gone in rows], ENT)


def test_dominant_records(spark):
    trust = spark.createDataFrame([("manual", 4), ("llm", 2)], "extracted_by string, trust int")
    d = [T(2024, 1, i) for i in range(1, 9)]
    rows = [
        (1, "A b", "x", ["one", " one ", "n/a", None], 0.5, "llm", d[0], None), (2, "a_B", "x", ["one", "two"], float("nan"), "manual", d[1], None),
        (3, "c", "x", ["one"], 0.5, "llm", d[0], None), (4, "C", "x", ["one"], 0.5, "llm", d[0], None),  # ties: nobody wins
        (5, "d", "x", ["-"], None, None, d[3], None), (6, "D ", "x", [], 1.5, "who", None, None),  # nothing usable
        (7, "e", "x", ["q"], 0.1, None, d[0], None), (8, "e", "x", None, 0.1, None, d[0], d[1]),  # the twin is deleted
        (9, "f", "x", ["q", "r"], 0.2, None, d[0], None), (10, "f", "x", ["q"], 0.2, None, d[5], None),  # more against newer
        (11, None, "x", ["q"], 0.2, None, d[0], None), (12, None, "x", ["q"], 0.2, None, d[0], None),
    ]
    got = sorted(tuple(r) for r in survivors.dominant_records(ent(spark, rows), trust).collect())
    assert got == [(1, "confidence", 1), (1, "observations", 2), (9, "confidence", 10)]
    assert survivors.dominant_records(ent(spark, []), trust).count() == 0


def copied_lists(groups=400):
    """Counts of patterns: a, b and d list items by themselves, b many false ones, and c copies nine tenths of b."""
    rnd, asked, patterns = random.Random(3), ("a", "b", "c", "d"), {}
    for g in range(groups):
        true = [f"t{i}" for i in range(6)]
        lists = {s: {t for t in true if rnd.random() < 0.6} for s in "abd"}
        for s, share in (("a", 0.1), ("b", 0.3), ("d", 0.1)):
            lists[s] |= {f"f{s}{k}" for k in range(max(1, round(len(lists[s]) * share / (1 - share)))) if rnd.random() < 0.9}
        lists["c"] = {x for x in lists["b"] if rnd.random() < 0.9}
        for item in set().union(*lists.values()):
            k = (tuple(s for s in asked if item in lists[s]), asked, False)
            patterns[k] = patterns.get(k, 0) + 1
    return [(*k, n) for k, n in patterns.items()], asked


def test_copied_votes_count_less():
    patterns, asked = copied_lists()
    m = survivors.fit_sources(patterns, list(asked), 12, 0.1, 0.8, 20)
    assert m.copies["b", "c"] > 0.99 and max(v for k, v in m.copies.items() if k != ("b", "c")) < 0.01
    assert m.acc["b"] < m.acc["a"] + 0.05 and m.acc["c"] < 0.9
    p = {v: survivors._posterior(v, asked, m, 0.8, 20, False) for v in (("b", "c"), ("a", "b"), ("b",), ("a", "d"))}
    assert p["a", "b"] > 0.9 and p["a", "d"] > 0.9 and p["b", "c"] < p["a", "b"] - 0.2
    # without the discount b's copies are believed
    alone = survivors.SourceModel(m.acc, m.recall)
    assert survivors._posterior(("b", "c"), asked, alone, 0.8, 20, False) > 0.9


def test_copies_of_single_values():
    rnd, asked, patterns = random.Random(1), ("a", "b", "c", "d"), {}
    for _ in range(400):
        own = {s: "true" if rnd.random() < r else f"{s}{rnd.randrange(20)}" for s, r in (("a", 0.9), ("b", 0.7), ("d", 0.9))}
        own["c"] = own["b"] if rnd.random() < 0.9 else "true"
        for v in set(own.values()):
            k = (tuple(s for s in asked if own[s] == v), asked, True)
            patterns[k] = patterns.get(k, 0) + 1
    m = survivors.fit_sources([(*k, n) for k, n in patterns.items()], list(asked), 12, 0.1, 0.8, 20)
    assert m.copies["b", "c"] > 0.99 and m.copies["a", "d"] < 0.01 and m.acc["b"] < m.acc["a"]


def test_who_was_first_tells_who_copies(spark):
    rnd, values = random.Random(1), []
    for _ in range(200):
        own = {s: 0.5 if rnd.random() < r else round(rnd.random(), 3) for s, r in (("a", 0.9), ("b", 0.6), ("d", 0.9))}
        values.append(own | {"c": own["b"] if rnd.random() < 0.85 else 0.5})
    values += [{"b": 0.25, "c": 0.25}] * 3  # only b and c speak here
    trust = spark.createDataFrame([("a", 4)], "extracted_by string, trust int")

    def fused(day):
        rows = [(10 * i + j, f"n{i}", "x", None, own[s], s, T(2024, 1, day[s]), None) for i, own in enumerate(values) for j, s in enumerate(own)]
        claims = survivors._claims(survivors.live_members(ent(spark, rows), trust), spark.createDataFrame([("x", f"n{i}", 10 * i) for i in range(len(values))], "entity_type string, key string, group_ord long"))
        early = {(r.early, r.late): r["n"] for r in survivors._orders(claims).collect()}
        return early, {r.group_ord: r for r in survivors.fused_fields(ent(spark, rows), trust).collect()}

    shared = sum(own["b"] == own["c"] for own in values)
    (late, c_later), (early, c_earlier) = fused({"a": 1, "b": 2, "c": 3, "d": 1}), fused({"a": 1, "b": 3, "c": 2, "d": 1})
    assert late["b", "c"] == shared == early["c", "b"] and ("c", "b") not in late and ("a", "d") not in late
    # c is better than b, as it corrects it here and there: what both say is worth less if c is the copy
    assert all(c_later[g].n_sources == 2 and c_later[g].posterior < c_earlier[g].posterior - 0.001 for g in (2000, 2010, 2020))


def test_direction_of_copying():
    patterns, asked = copied_lists()
    fit = lambda earlier: survivors.fit_sources(patterns, list(asked), 12, 0.1, 0.8, 20, earlier)
    m, back = fit({("b", "c"): 90, ("c", "b"): 6, ("a", "d"): 50}), fit({("c", "b"): 90, ("b", "c"): 6})
    assert m.copies["b", "c"] > 0.99 and m.copies["a", "d"] < 0.01  # a source late in everything is no copier
    assert m.copier["c", "b"] > 0.99 and back.copier["c", "b"] < 0.01
    assert m.originals_first(("a", "b", "c"), m.acc) == ["b", "a", "c"] and back.originals_first(("a", "b", "c"), m.acc) == ["c", "a", "b"]
    assert fit(None).originals_first(("a", "b", "c"), m.acc) == sorted("abc", key=lambda s: -m.acc[s])


def test_fused_fields(spark):
    trust = spark.createDataFrame([("manual", 4)], "extracted_by string, trust int")
    rows = [(1, "a", "x", ["one"], 0.5, "manual", T(2024, 1, 1), None), (2, "a", "x", ["one", "two"], 0.5, "llm", T(2024, 1, 1), None), (3, "A", "x", ["one"], 0.7, "ast", T(2024, 1, 1), None)]
    got = {(r.field, r.item) for r in survivors.fused_fields(ent(spark, rows), trust).collect()}
    assert ("observations", "one") in got and ("confidence", "0.500") in got


def test_too_many_vote_patterns_are_an_error(spark):
    trust = spark.createDataFrame([("manual", 4)], "extracted_by string, trust int")
    rows = [(1, "a", "x", ["one"], 0.5, "manual", T(2024, 1, 1), None), (2, "a", "x", ["one", "two"], 0.5, "llm", T(2024, 1, 1), None)]
    with pytest.raises(ValueError):
        survivors.fused_fields(ent(spark, rows), trust, most_patterns=1)
    assert survivors.fused_fields(ent(spark, rows), trust, most_patterns=5).count() > 0


def test_automaton_finds_all_neighbours():
    def dist(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(150)})
    trie = names.build_trie(words)
    for q in words[:40]:
        assert sorted(w for w, _ in names.neighbours(q, trie, 2)) == sorted(w for w in words if dist(q, w) <= 2)


def test_names_link_variants_only(spark):
    same = [
        ["Theodore Norketnuumiwell", "Norketnuumiwell, Theodore", "Dr. Theodore Norketnuumiwell", "Throdore Norketnuumiwell", "Theodore Norketmuumiwell", "Ted Norketnuumiwell", "T. Norketnuumiwell", "THEODORE NORKETNUUMIWELL"],
        ["Hartlomackstead Grain Exchange", "Grain Exchange of Hartlomackstead", "The Hartlomackstead Grain Exchange Ltd", "Hartlpmackstead Grain Exchange"],
        ["Hartlomackstead Mutual Insurance", "Hartlomackstead Mutual Ins."], ["Robert Havviklieström", "Bob Havvikliestroem"], ["Amina Norketnuumiwell"],
    ]
    rows, want = [], set()
    for group in same:
        ids = list(range(len(rows), len(rows) + len(group)))
        rows += [(i, n, None if i % 2 else []) for i, n in zip(ids, group)]
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(90, None, None), (91, " ", [None]), (92, "XQZ-7", ["Robert Havviklieström"])]
    want |= {(i, 92) for i, n, _ in rows if n and "Havvik" in n}
    df = spark.createDataFrame(rows, "ord long, name string, aliases array<string>").selectExpr("*", "'x' AS cluster")
    got = {(r.ord_a, r.ord_b) for r in names.same_entity_pairs(names.name_clusters(df)).collect()}
    assert got == want


def test_a_typo_in_many_names_is_a_typo(spark):
    places = ["".join(x) for x in itertools.product(["hart", "norke", "vellu"], ["lomack", "tnuumi", "bassin", "gorthe"], ["stead", "well", "drup"])]
    rows = [(i, f"{p} Systemic Bureau") for i, p in enumerate(places)] + [(100 + i, f"{places[i]} Sysremic Bureau") for i in range(4)]
    rows += [(200 + i, f"{places[i]} Systolic Bureau") for i in range(4, 16)]  # another word, half as frequent
    df = spark.createDataFrame(rows, "ord long, name string").selectExpr("*", "CAST(NULL AS ARRAY<STRING>) AS aliases")
    got = {(r.ord_a, r.ord_b) for r in names.same_entity_pairs(names.name_clusters(df)).collect()}
    assert got == {(i, 100 + i) for i in range(4)}


def test_raking_meets_sources_within_caps():
    cells = {("a", "en", "x"): 100.0, ("a", "de", "x"): 50.0, ("b", "en", "y"): 40.0}
    caps, want = {"a": 1.0, "b": 3.0}, {"a": 90.0, "b": 90.0}
    w = mixing.rake(cells, caps, want, {"en": 140.0, "de": 50.0}, {"x": 150.0, "y": 40.0})
    assert all(w[k] <= caps[k[0]] + 1e-9 for k in cells)
    for s in want:
        assert abs(sum(cells[k] * w[k] for k in cells if k[0] == s) - want[s]) < 1e-3


def test_mixture(spark):
    docs = [(i, "word " * (20 + i % 30), "en", " Big-Source" if i % 3 else "small_source") for i in range(900)] + [(2000, None, None, "small_source"), (2001, " ", "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS copies")
    goal = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.4, 2), ("absent", 0.1, None)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mixture(df, goal)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big_source"].reached_share - 0.5 / 0.9) < 0.01 and abs(r["small_source"].reached_share - 0.4 / 0.9) < 0.01
    assert r["absent"].reached_share == 0 and r["small_source"].most_copies <= 2 and r["big_source"].most_copies <= 1
    assert drawn.filter("doc_id >= 2000").count() == 0


def test_subjects_on_held_out_documents(spark):
    rnd = random.Random(6)
    vocab = {"law": ["court", "statute", "injunction", "appeal"], "software": ["parser", "compiler", "cache", "thread"]}

    def text(parts):
        return " ".join(f"We find that the {rnd.choice(vocab[s])} limits the {rnd.choice(vocab[s])} in most of the cases." for s in parts)

    docs, want = [], {}
    for i in range(160):
        parts = [["law"] * 6, ["software"] * 6, ["law", "law", "law", "software", "software", "software"]][i % 3]
        docs.append((i, text(parts), "s"))
        want[i] = set(parts)
    docs += [(900, None, "s"), (901, "  ", None), (902, "The rest is unchanged.", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' AS subject")
    lab = spark.createDataFrame([(i, s, "ann") for i in range(60) for s in want[i]] + [(5, None, None), (7777, "law", "a")], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("law",), ("software",), (None,)], "subject string")
    got: dict = {}
    for r in subjects.document_subjects(df, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(60, 160)]
    assert sum(got.get(i, set()) == want[i] for i in held) >= 0.95 * len(held)
    assert not {900, 901} & set(got)
    assert subjects.document_subjects(df.limit(0), lab, areas).count() == 0
    with pytest.raises(ValueError):
        subjects.document_subjects(df, lab, areas, max_subjects=1)


def test_the_chain_decides_on_subjects():
    import numpy as np

    rng = np.random.default_rng(2)
    share = rng.dirichlet((1, 1, 1), 1500)
    x = subjects._features(share, np.full(1500, 900.0), np.ones(1500), ["s"] * 1500, ["s"], 1 / 3)
    y = (share[:, :2] >= 1 / 3).astype(float)
    chain = subjects.Chain(x[:1000], y[:1000], 2).calibrate(x[1000:1200], y[1000:1200])
    assert (chain.decode_all(x[1200:]) == y[1200:]).mean() > 0.98
    # where two subjects never go together the chain doesn't give both
    y[:, 1] *= 1 - y[:, 0]
    apart = subjects.Chain(x[:1000], y[:1000], 2).decode_all(x[1200:])
    assert (apart.sum(1) == 2).mean() < 0.02

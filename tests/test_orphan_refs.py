import datetime as dt

from veinwork.operators.orphan_refs import child_keys, orphan_counts, orphan_references, parent_keys

T = dt.datetime
PARENT = "ord long, name string, aliases array<string>, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
CHILD = "ord long, source string, target string, recorded_at timestamp_ntz, loaded_at timestamp_ntz, key string, month string"


def run(spark, parents, rows):
    p = parent_keys(spark.createDataFrame(parents, PARENT))
    c = child_keys(spark.createDataFrame(rows, CHILD), "relations", ["source", "target"])
    return orphan_references(p, c)


def test_kinds_and_boundaries(spark):
    parents = [
        (1, "Bank A", ["B  A", None], T(2024, 1, 10), T(2024, 2, 1), "x"),
        (2, "bank_a", None, T(2024, 3, 1), None, "x"),
        (3, "Late", [], T(2025, 1, 1), None, "x"),
        (4, "Ever", [], None, None, "x"),
        (5, None, None, T(2024, 1, 1), None, None),
    ]
    m = T(2024, 5, 3)
    rows = [
        (1, "BANK\u00a0 a", "b a", m, T(2024, 1, 10), "clash", "clash"),  # lives from its moment on
        (2, "Bank A", "Nobody", m, T(2024, 2, 1), None, None),  # deleted at that moment
        (3, " late ", None, m, T(2024, 12, 31), None, None),
        (4, "", " _ ", m, T(2024, 1, 1), None, None),  # blank ends are no references
        (5, "Ever", "bank_A", m, T(2024, 3, 1), None, None),
        (6, "Nobody", "Ever", None, None, None, None),  # judged without a moment
        (2, "Bank A", "Nobody", m, T(2024, 2, 1), None, None),  # delivered twice
        (7, "Bank A", "Ever", m, T(2024, 1, 1), None, None),  # before its first record
    ]
    found = run(spark, parents, rows)
    got = {(r.ord, r.field, r.kind) for r in found.collect()}
    assert got == {(2, "source", "deleted"), (2, "target", "missing"), (3, "source", "late"), (6, "source", "missing"), (7, "source", "late")}
    counts = {(r.field, str(r.month), r.kind): r.n_refs for r in orphan_counts(found).collect()}
    assert counts[("target", "2024-05-01", "missing")] == 1
    assert counts[("source", "None", "missing")] == 1


def test_hot_key_matches_plain_join(spark):
    parents = [(1, "hot", [], T(2024, 1, 1), T(2024, 6, 1), None), (2, "hot", [], T(2024, 5, 1), T(2024, 7, 1), None)]
    rows = [(i, "hot", f"t{i}", T(2024, 1, 1), T(2024, 1 + i % 9, 1), None, None) for i in range(3000)]
    got = {r.ord for r in run(spark, parents, rows).collect() if r.field == "source"}
    assert got == {i for i in range(3000) if 1 + i % 9 >= 7}


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert [r.kind for r in run(spark, [], [(1, "a", None, None, T(2024, 1, 1), None, None)]).collect()] == ["missing"]

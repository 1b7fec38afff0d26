import __spark_entry__ as entry


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() > 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert "p1_found" in q


def test_core_does_not_need_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "veinwork"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "veinwork.llm" not in p.read_text(), p

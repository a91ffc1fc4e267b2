"""Every query of the catalog against its SQL on the smallest tables."""

import pytest


from graphloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(map(str, r)) for r in got.select(*columns).collect()]
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(rows) == sorted(want)
    assert rows, "an empty result compares nothing"


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_brace_lateral_is_spread(spark):
    from graphloom import catalog

    rows = catalog.queries()["brace_lateral"](spark, "/root/testdata/sf0.001")
    assert rows.selectExpr("spark_partition_id() as p").distinct().count() > 1


def test_imports_are_derived_once(spark, monkeypatch):
    from graphloom import catalog
    from graphloom.sources.testdata import frame

    monkeypatch.setattr(catalog.graph, "unreachable_modules", lambda modules, edges: modules)
    for make in (catalog.unreachable_modules, catalog.statistics_blocks):
        read = []
        make(lambda t, stream=False, read=read: read.append(t) or frame(spark, "/root/testdata/sf0.001", t))
        assert read.count("import") + read.count("edge") == 1


def test_dead_modules_read_written_edges(spark, monkeypatch):
    from graphloom.operators import graph

    given = []
    monkeypatch.setattr(graph, "reachable", lambda entries, edges: given.append(edges) or entries)
    modules = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False)], "module_id long, path string, is_entry boolean")
    found = graph.dead_modules(modules, spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert [tuple(r) for r in found.collect()] == [(3, "c", 1)]
    assert given[0].inputFiles()

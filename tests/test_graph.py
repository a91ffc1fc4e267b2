import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import graph


def frames(spark, edges, entries=()):
    return spark.createDataFrame(list(edges), "src long, dst long"), spark.createDataFrame([(x,) for x in entries], "module_id long")


def sccs(spark, edges, **limits):
    return sorted(tuple(r) for r in graph.components(frames(spark, edges)[0], **limits).collect())


def test_cycles(spark):
    assert sccs(spark, [(1, 2), (2, 3), (3, 1)]) == [(1, 1), (2, 1), (3, 1)]
    assert sccs(spark, [(1, 2), (2, 3)]) == []
    assert sccs(spark, [(1, 2), (2, 1), (3, 4), (4, 3)]) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert sccs(spark, [(1, 1)]) == []


def closure(edges, nodes):
    seen, todo = set(nodes), list(nodes)
    while todo:
        x = todo.pop()
        todo += (fresh := {b for a, b in edges if a == x} - seen)
        seen |= fresh
    return sorted(seen)


@pytest.mark.parametrize("jumps", [True, False])
def test_reachable_over_chains_rings_and_hubs(spark, jumps):
    chain = [(k, k + 1) for k in range(20)]
    edges = [*chain, (20, 0), (7, 30), (30, 31), (31, 32), (40, 41), (41, 40), (41, 42), (42, 43), (12, 50), (13, 50), (50, 51), (51, 50), (60, 60), (61, 60)]
    for nodes in ([0], [31, 42], [60, 99], [5, 41]) if jumps else ([5, 41],):
        e, entries = frames(spark, edges, nodes)
        assert sorted(r[0] for r in graph.reachable(entries, e, jumps).collect()) == closure(edges, nodes)


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    """Rings and chains of 20,000 nodes: rounds grow with the logarithm, and nothing but counts comes to the driver."""
    from graphloom.operators import fixpoints

    rounds, cut, counting = [], fixpoints.cut, fixpoints.cut_counting
    monkeypatch.setattr(fixpoints, "cut", lambda df, name: rounds.append(name) or cut(df, name))
    monkeypatch.setattr(fixpoints, "cut_counting", lambda df, name, test: rounds.append(name) or counting(df, name, test))
    ring = spark.range(20_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 20_000).alias("dst"))
    assert tuple(graph.components(ring).agg(F.count("*"), F.max("scc_id")).first()) == (20_000, 0)
    assert len(rounds) < 60
    rounds.clear()
    assert graph.reachable(spark.createDataFrame([(7,)], "module_id long"), ring.where("src < 19999")).count() == 19_993
    assert len(rounds) < 30


def test_chain_of_components(spark):
    """Twelve pairs, each importing the next: every pair is a component of its own, whichever number is least."""
    edges = [e for k in range(12) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2))]
    assert sccs(spark, edges) == [(k, k - k % 2) for k in range(24)]


def test_components_of_paths(spark):
    e = spark.createDataFrame([("b.ts", "a.ts"), ("a.ts", "b.ts"), ("c.ts", "a.ts"), (None, "a.ts")], "src string, dst string")
    assert sorted(map(tuple, graph.components(e).collect())) == [("a.ts", "a.ts"), ("b.ts", "a.ts")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=16))
def test_components_are_mutual_reachability(spark, edges):
    reach = {(a, b) for a, b in edges}
    for k in range(8):
        reach |= {(a, b) for a in range(8) for b in range(8) if (a, k) in reach and (k, b) in reach}
    want = sorted((a, min(b for b in range(8) if b == a or (a, b) in reach and (b, a) in reach)) for a in range(8) if any(b != a and (a, b) in reach and (b, a) in reach for b in range(8)))
    assert sccs(spark, edges) == want


def test_chain_over_five(spark):
    e, entries = frames(spark, [(k, k + 1) for k in range(6)], [0])
    assert [tuple(r) for r in graph.chains(entries, e).collect()] == [(6, 6, "0>1>2>3>4>5>6")]


def test_chains_have_no_bound(spark):
    e, entries = frames(spark, [(k, k + 1) for k in range(12)] + [(3, 1)], [0])
    assert sorted(r["depth"] for r in graph.chains(entries, e).collect()) == list(range(6, 13))


def test_safety_order(spark):
    rows = [("a", True, True), ("x/next.config.js", False, True), ("b", False, True), ("c", False, False)]
    df = spark.createDataFrame(rows, "path string, is_entry boolean, has_side_effects boolean")
    got = {r["path"]: (r["verdict"], r["reason"]) for r in df.withColumns(graph.safety(F.lit(False))).collect()}
    assert got == {"a": ("Unsafe", "Entry point"), "x/next.config.js": ("Unsafe", "Configuration file"), "b": ("ReviewCarefully", "Module has side effects"), "c": ("SafeToDelete", "")}


def test_bundle(spark):
    rows = spark.createDataFrame([(1000, False), (2000, True), (500, False)], "size long, has_side_effects boolean")
    assert tuple(graph.bundle_impact(rows).first()) == (3, 3500, 1500)
    assert graph.bundle_impact(rows.where("false")).first()["total_bytes"] is None


def test_star_reexports_have_no_bound(spark):
    """a0 passes on a1's names and so on to a6, and a cycle of barrels ends."""
    modules = spark.createDataFrame([(k, f"a{k}.ts", False) for k in range(9)], "module_id long, path string, is_entry boolean")
    exports = spark.createDataFrame([(6, "deep", "Named", False), (6, "other", "Named", False), (8, "ring", "Named", False)], "module_id long, name string, kind string, is_type_only boolean")
    taken = spark.createDataFrame([(8, 0, "Static", "Named", "deep")], "module_id long, resolved_to long, kind string, specifier string, name string")
    stars = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(7, 8), (8, 7)], "module_id long, origin long")
    assert sorted(r["name"] for r in graph.unused_exports(modules, exports, taken, stars).collect()) == ["other", "ring"]


def test_late_rounds_follow_what_moved(spark, monkeypatch):
    """A ring of 30 with a second way into every node keeps a few labels moving long after 400 pairs have settled: those rounds write only what moved, and the edges are derived once."""
    from graphloom.operators import fixpoints

    names, cut, counting = [], fixpoints.cut, fixpoints.cut_counting
    monkeypatch.setattr(fixpoints, "cut", lambda df, name: names.append(name) or cut(df, name))
    monkeypatch.setattr(fixpoints, "cut_counting", lambda df, name, test: names.append(name) or counting(df, name, test))
    ring = [e for k in range(30) for e in ((k, (k + 1) % 30), (100 + k, k), (k, 100 + k))]
    pairs = [e for k in range(400) for e in ((1000 + 2 * k, 1001 + 2 * k), (1001 + 2 * k, 1000 + 2 * k))]
    want = [(k, 0) for k in (*range(30), *range(100, 130))] + [(k, k - k % 2) for k in range(1000, 1800)]
    assert sccs(spark, ring + pairs) == want
    assert "edges" in names and "moved" in names


def test_what_has_one_way_in_takes_no_labels(spark, monkeypatch):
    """Long chains with edges back, side branches that come back or not, and chains into other cycles: labels go over the few nodes with several ways in."""
    from graphloom.operators import fixpoints

    numbered, sizes = fixpoints._numbered, []
    monkeypatch.setattr(fixpoints, "_numbered", lambda edges: sizes.append(edges.count()) or numbered(edges))
    line = lambda *nodes: list(zip(nodes, nodes[1:]))
    edges = [*line(*range(61)), (40, 0), (50, 0), *line(20, *range(100, 131)), (130, 5), *line(10, *range(200, 220)), *line(300, *range(301, 320), 45), *line(219, 400, 401, 400)]
    edges += [*line(401, 500, *range(501, 530), 500), *line(529, 600, 601), (510, 500)]
    reach = {k: set(closure(edges, [k])) for k in {x for e in edges for x in e}}
    want = sorted((k, min(x for x in reach[k] if k in reach[x])) for k in reach if sum(k in reach[x] for x in reach[k]) > 1)
    assert sccs(spark, edges, trim=False) == want
    assert len(want) > 110 and max(sizes) < 12


def test_components_of_near_forests(spark):
    """200 graphs beside each other in which almost every node has one way in, so that they are contracted: components are still mutual reachability."""
    import random

    rng, edges, want = random.Random(5), [], []
    for base in range(0, 2800, 14):
        own = [(base + rng.randrange(14), base + k) for k in range(rng.randint(8, 13))] + [(base + rng.randrange(14), base + rng.randrange(14)) for _ in range(rng.randrange(5))]
        reach = {base + k: set(closure(own, [base + k])) for k in range(14)}
        want += [(k, min(x for x in reach[k] if k in reach[x])) for k in reach if any(x != k and k in reach[x] for x in reach[k])]
        edges += own
    assert sccs(spark, edges, trim=False) == want


def test_cycle_sizes_derive_the_edges_once(spark, monkeypatch):
    from graphloom import catalog

    asked, frame = [], catalog.frame
    monkeypatch.setattr(catalog, "frame", lambda s, d, name, *more, **given: asked.append((name, "edge" in given)) or frame(s, d, name, *more, **given))
    assert catalog.queries()["cycle_sizes"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked.count(("edge", False)) == 1 and ("ring", True) in asked and ("ring", False) not in asked

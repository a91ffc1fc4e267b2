"""Chains by brute force on small graphs, and on a graph with more chains than could be listed."""

import random

from graphloom.operators import chains


def frames(spark, entries, edges):
    return spark.createDataFrame([(x,) for x in entries], "module_id long"), spark.createDataFrame(edges, "src long, dst long")


def test_summary_by_brute_force(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)} | {(20, 21), (21, 22), (22, 20), (3, 20), (22, 23), (23, 24), (30, 31)})
    entries = [0, 3]
    nodes = {x for e in edges for x in e} | set(entries)
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in edges:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    group = {v: min(w for w in reach[v] if v in reach[w]) for v in nodes}
    steps = {(group[a], group[b]) for a, b in edges if group[a] != group[b]}
    paths = [(group[x],) for x in sorted({group[e] for e in entries})]
    for p in paths:
        paths += [(*p, b) for a, b in steps if a == p[-1]]
    near = dict.fromkeys(entries, 0)
    for _ in nodes:
        for a, b in edges:
            if a in near:
                near[b] = min(near.get(b, 99), near[a] + 1)
    got = {r["module_id"]: r for r in chains.chain_summary(*frames(spark, entries, edges), best=2).collect()}
    assert set(got) == set(near)
    for v, r in got.items():
        own = [p for p in paths if p[-1] == group[v]]
        assert (r["depth"], r["longest"], r["chains"]) == (near[v], max(map(len, own)) - 1, len(own))
        via = sorted(a for a, b in edges if b == v and a != v and near.get(a, 99) + 1 == near[v])[:2]
        assert (r["via"] or []) == via


def test_more_chains_than_can_be_listed(spark):
    """A ladder of 12 diamonds has 2^12 chains to its end."""
    edges = [e for k in range(12) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    entries, frame = frames(spark, [0], edges)
    got = {r["module_id"]: r for r in chains.counted_chains(entries, frame).collect()}
    assert got[36]["chains"] == 2.0**12
    assert got[36]["longest"] == 24


def test_unfolding(spark):
    entries, edges = frames(spark, [0, 50], [(k, k + 1) for k in range(8)] + [(3, 1), (50, 5)])
    summary = chains.chain_summary(entries, edges)
    got = {r["module_id"]: r["chain"] for r in chains.unfold(summary, summary.where("module_id in (4, 8, 0)")).collect()}
    assert got == {4: [0, 1, 2, 3, 4], 8: [50, 5, 6, 7, 8], 0: [0]}


def test_components_of_what_is_reached_alone(spark, monkeypatch):
    """Rings and lines that no entry reaches cost no rounds, and change nothing."""
    given = []
    own = chains.components
    monkeypatch.setattr(chains, "components", lambda edges: given.append(edges.count()) or own(edges))
    near = [(0, 1), (1, 2), (2, 1), (2, 3)]
    far = [(10, 11), (11, 10), (11, 1), (12, 13), (13, 14), (14, 2)]
    rows = lambda edges: sorted(chains.chain_summary(*frames(spark, [0], edges)).collect())
    assert rows(near + far) == rows(near)
    assert given == [4, 4]

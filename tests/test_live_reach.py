"""Reachability over streamed changes equals a full run after every batch."""

import random

from graphloom.operators import fixpoints, graph
from graphloom.streaming import live_reach


def test_batches_equal_full_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_reach, "EVERY", 2)
    rng = random.Random(9)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)} | {(0, 20), (20, 21), (21, 22), (22, 20), (22, 23)}
    entries = spark.createDataFrame([(0,), (5,)], "module_id long")
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    live = live_reach.LiveReach(spark, f"file://{tmp_path}/state")
    live.begin(entries, frame(edges))
    batches = [
        [(0, 20, "remove", 1), (3, 3, "add", 2), (99, 98, "remove", 3)],  # cuts off a ring that holds itself
        [(5, 22, "add", 1), (5, 22, "remove", 2), (5, 21, "add", 3), *((a, b, "remove", 4) for a, b in rng.sample(sorted(edges), 4))],
        [(5, 21, "remove", 1), (0, 21, "add", 2), (30, 31, "add", 3), *((rng.randrange(12), rng.randrange(12), "add", 9) for _ in range(3))],
    ]
    source = f"{tmp_path}/changes"
    for n, rows in enumerate(batches, 1):
        spark.createDataFrame(rows, "src long, dst long, op string, seq int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("src long, dst long, op string, seq int").parquet(source)
        live.start(stream, f"{tmp_path}/checkpoint").awaitTermination(240)
        for a, b, op, _ in sorted(rows, key=lambda r: r[3]):
            (edges.add if op == "add" else edges.discard)((a, b))
        want = sorted(r[0] for r in graph.reachable(entries, frame(edges), jumps=False).collect())
        assert sorted(r[0] for r in live.after(n).collect()) == want
        assert sorted(map(tuple, live.edges.read(n).collect())) == sorted((a, b) for a, b in edges if a != b)
    live.apply(spark.createDataFrame(batches[-1], "src long, dst long, op string, seq int"), 2)  # a batch that runs again
    assert sorted(r[0] for r in live.after(3).collect()) == want


def test_large_batches_take_few_writes(spark, tmp_path, monkeypatch):
    """A line of 60 modules is added at once and then taken away at its head: neither is followed module by module."""
    writes = []
    for module in (live_reach, fixpoints):
        for name in ("cut", "cut_counting"):
            monkeypatch.setattr(module, name, lambda df, label, *test, f=getattr(module, name): (writes.append(label), f(df, label, *test))[1])
    monkeypatch.setattr(live_reach, "FRONT", 0)
    entries, near = spark.createDataFrame([(0,), (200,)], "module_id long"), [(0, 1), (200, 201), (0, 60)]
    line = [(k, k + 1) for k in range(1, 60)]
    live = live_reach.LiveReach(spark, f"file://{tmp_path}/state")
    live.begin(entries, spark.createDataFrame(near, "src long, dst long"))
    writes.clear()
    live.apply(spark.createDataFrame([(*e, "add", 1) for e in line], "src long, dst long, op string, seq int"), 0)
    assert sorted(r[0] for r in live.after(1).collect()) == [*range(61), 200, 201]
    live.apply(spark.createDataFrame([(0, 1, "remove", 1)], "src long, dst long, op string, seq int"), 1)
    assert sorted(r[0] for r in live.after(2).collect()) == [0, 60, 200, 201]
    assert len(writes) < 60
    live.apply(spark.createDataFrame([(0, 60, "remove", 1), (200, 59, "add", 1)], "src long, dst long, op string, seq int"), 2)  # both in one batch
    assert sorted(r[0] for r in live.after(3).collect()) == [0, 59, 60, 200, 201]

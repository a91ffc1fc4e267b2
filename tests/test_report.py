"""Accuracy and containing paths against plain loops."""

import random

from graphloom.operators import report


def test_containing_by_brute_force(spark):
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9)))
    a = [(rng.choice(["", "x", "y"]), piece() + rng.choice(["", "src/foo.ts", "foo"])) for _ in range(60)] + [("x", ""), ("x", "src/foo.ts.bak")]
    b = [(rng.choice(["", "x", "y"]), rng.choice(["src/foo.ts", "", "foo.ts", "o", "ab"]) + piece()) for _ in range(60)] + [("x", "src/foo.ts")]
    want = sorted({(n, p, q) for n, p in a for m, q in b if n == m and p and q and (p in q or q in p)})
    got = report.containing(*(spark.createDataFrame(x, "name string, path string") for x in (a, b)))
    assert sorted(map(tuple, got.collect())) == want
    assert ("x", "src/foo.ts.bak", "src/foo.ts") in want


def test_accuracy_takes_the_first_match(spark):
    truth = [(0, "src/a.ts", "one", True), (1, "a.ts", "one", True), (2, "src/a.ts", "two", False), (3, "src/b.ts", None, False), (4, "src/b.ts", None, True), (5, "c.ts", "x", True)]
    found = [("SRC\\A.ts", "ONE"), ("src/a.ts", "one"), ("/r/src/a.ts", "two"), ("src/b.ts.bak", None), ("src/b.ts", "named"), ("none.ts", "x")]
    frames = spark.createDataFrame(found, "path string, name string"), spark.createDataFrame(truth, "position int, path string, name string, is_unused boolean")
    row = report.accuracy(*frames).first()
    assert (row["tp"], row["fp"], row["fn"]) == (3, 1, 2)
    assert report.accuracy(*frames, compat=True).first()["tp"] == 5


def test_pieces_are_not_broadcast(spark, monkeypatch):
    """Files of paths are small and their pieces are not, so no join of pieces may be planned by the size of the paths' files."""
    plans, cut = [], report.cut
    monkeypatch.setattr(report, "cut", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df, name))
    rows = spark.createDataFrame([("x", "src/foo.ts"), ("x", "foo.ts"), ("y", "src/bar.ts.bak")], "name string, path string")
    assert report.containing(rows, rows).count() == 5
    assert sum(x.count("SortMergeJoin") for x in plans) == 5 and not any("BroadcastHashJoin" in x for x in plans)


def test_pieces_travel_as_numbers_and_few(spark, monkeypatch):
    """Paths of all lengths, of two-byte letters too, against a loop: no piece is made a row of its path, and a long path gives a part of its pieces."""
    import numpy as np
    import pyarrow as pa

    plans, cut = [], report.cut
    monkeypatch.setattr(report, "cut", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df, name))
    rng = random.Random(11)
    long = ["".join(rng.choice("abé/") for _ in range(rng.randint(1, 90))) for _ in range(80)]
    part = lambda p: p[(k := rng.randrange(len(p))) : k + rng.randint(1, 60)]
    a = [(rng.choice("xy"), p) for p in long] + [("x", part(p)) for p in long]
    b = [(rng.choice("xy"), part(rng.choice(long))) for _ in range(200)] + [("x", "aaaaaaaaaaaa" * k) for k in range(1, 6)] + [("x", p) for p in long[:5]]
    want = sorted({(n, p, q) for n, p in a for m, q in b if n == m and (p in q or q in p)})
    got = report.containing(*(spark.createDataFrame(x, "name string, path string") for x in (a, b)))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert not any("Generate" in x for x in plans)
    paths = ["".join(rng.choice("abcdefgh/") for _ in range(60)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 100), pa.array(paths)], names=["seed", "path"])
    all_bits = {report.GRAM + 4: np.full(report.BITS >> 6, 2**64 - 1, np.uint64)}
    assert 100 * 2 < len(report._asked_pieces(batch, report.GRAM, np.zeros(report.BUCKETS, np.int64), all_bits)[0]) < 100 * 55 / 4

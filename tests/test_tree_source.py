"""The data source of source files against discover(), its pushed filters, and the stream of changed files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.sources.tree_source import Tree, register_source


@pytest.fixture
def root(spark, tmp_path):
    register_source(spark)
    texts = {
        "repo/.gitignore": "*.gen.ts\n/app/above/", "repo/app/.gitignore": "gen/\n*.log.js\n!keep.log.js\nout/*\n!out/kept.ts", "repo/app/src/.gitignore": "!deep.gen.ts\nlocal.ts",
        "repo/app/src/a.ts": "import './empty'", "repo/app/src/empty.ts": "", "repo/app/gen/x.ts": "1", "repo/app/a.log.js": "1", "repo/app/keep.log.js": "keep", "repo/app/out/b.ts": "1", "repo/app/out/kept.ts": "1",
        "repo/app/z.gen.ts": "1", "repo/app/src/deep.gen.ts": "é", "repo/app/src/local.ts": "1", "repo/app/local.ts": "1", "repo/app/above/c.ts": "1", "repo/app/.hidden/h.ts": "1", "repo/app/n.md": "1", "repo/app/ts": "1",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "repo" / ".git").mkdir()
    os.symlink(tmp_path / "repo/app/src/a.ts", tmp_path / "repo/app/link.ts")
    return tmp_path / "repo" / "app"


def test_equals_discover(spark, root):
    read = lambda **options: spark.read.format("sources").options(**options)
    for git in (True, False):
        got, want = read(git=git).load(str(root)), files.discover(spark, str(root), git=git)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert read(bytes=1).load(str(root)).rdd.getNumPartitions() == 6
    assert [r["path"] for r in read(extensions="md").load(str(root)).collect()] == ["n.md"]
    (root / "none").mkdir()
    assert read().load(str(root / "none")).count() == 0
    (root / "bad.ts").write_bytes(b"\xff")
    assert read().load(str(root)).where("path = 'bad.ts'").first()["content"] == "�"
    for bad in ("/etc", str(root / "missing")):
        with pytest.raises(Exception, match="refusing|no such folder"):
            read().load(bad).collect()


def test_filters_reach_the_listing(spark, root):
    rows = spark.read.format("sources").load(str(root))
    everything = [("keep.log.js", 4), ("local.ts", 1), ("out/kept.ts", 1), ("src/a.ts", 16), ("src/deep.gen.ts", 2), ("src/empty.ts", 0)]
    cases = [
        (F.col("path").startswith("src/"), lambda p, n: p.startswith("src/")), (F.col("path").startswith("s"), lambda p, n: p.startswith("s")), (F.col("path").endswith(".js"), lambda p, n: p.endswith(".js")),
        (F.col("length") > 3, lambda p, n: n > 3), (F.col("path").isin("src/a.ts", "out/kept.ts"), lambda p, n: p in ("src/a.ts", "out/kept.ts")), (F.col("path") == "src/a.ts", lambda p, n: p == "src/a.ts"),
        (F.col("path").contains("ep") & (F.col("length") <= 2), lambda p, n: "ep" in p and n <= 2), (F.col("content").contains("import") & F.col("path").contains("/"), lambda p, n: p == "src/a.ts"), (F.col("path").rlike("^s.*a") & (F.col("path") > "out"), lambda p, n: p == "src/a.ts"),
    ]
    for condition, keep in cases:
        got = sorted((r["path"], r["length"]) for r in rows.where(condition).collect())
        assert got == [x for x in everything if keep(*x)]
    plan = rows.where(F.col("path").startswith("src/") & F.col("content").rlike("x")).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "RLIKE" in plan  # what the listing answered is gone from the plan


def test_folders_that_cannot_match_stay_closed(root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    seen, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (seen.append(os.path.relpath(p, root)), scan(p))[1])
    for f, want in ((StringStartsWith(("path",), "src/d"), [".", "src"]), (EqualTo(("path",), "out/kept.ts"), [".", "out"]), (StringStartsWith(("path",), "s"), [".", "src"])):
        tree = Tree(str(root))
        assert list(tree.push([IsNotNull(("path",)), f])) == []
        assert list(tree.files())
        assert seen == want
        seen.clear()


def test_stream_of_changed_files(spark, root, tmp_path):
    def step():
        stream = spark.readStream.format("sources").option("settle", 0.2).load(str(root))
        stream.writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out" / f"b{k}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        done = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
        new = [p for p in done if p not in before]
        before.update(done)
        return sorted((r["path"], r["content"]) for p in new for r in spark.read.parquet(str(p)).collect())

    before = set()
    (tmp_path / "out").mkdir()
    time.sleep(0.3)
    first = step()
    assert len(first) == 6 and ("src/a.ts", "import './empty'") in first
    (root / "src/a.ts").write_text("changed")
    (root / "gen/new.ts").write_text("ignored")
    (root / "fresh.ts").write_text("new")
    old = root / "old.ts"
    old.write_text("old")
    os.utime(old, (1, 1))  # a copy that keeps its old time
    time.sleep(0.3)
    assert step() == [("fresh.ts", "new"), ("old.ts", "old"), ("src/a.ts", "changed")]
    (root / "fresh.ts").unlink()
    assert step() == []
    os.rename(root / "old.ts", root / "renamed.ts")
    time.sleep(0.3)
    assert step() == [("renamed.ts", "old")]

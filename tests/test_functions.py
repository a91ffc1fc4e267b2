import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import registry, text, versions
from graphloom.operators import findings, quality


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "shown"), [(500, "500 bytes"), (1536, "1.5 KB"), (2097152, "2.00 MB")])
def test_format_bytes(spark, n, shown):
    assert one(spark, text.format_bytes(F.col("n")), n=n) == shown


def test_braces():
    assert text.expand_braces("file.{ts,js}.{map,bak}") == ["file.ts.map", "file.ts.bak", "file.js.map", "file.js.bak"]
    assert text.expand_braces("file.ts") == ["file.ts"]


@pytest.mark.parametrize("path", ["node_modules/react/index.js", "project/node_modules/lodash/index.js", ".next/static/foo.js", "dist/bundle.js", "build/output.js"])
def test_default_ignores(path):
    assert any(re.search(text.glob_to_regex(g), path) for g in findings.DEFAULT_IGNORES)


@pytest.mark.parametrize("path", ["src/index.js", "pages/about.tsx", "utils/helpers.ts"])
def test_kept_paths(path):
    assert not any(re.search(text.glob_to_regex(g), path) for g in findings.DEFAULT_IGNORES)


def test_attribution(spark):
    rows = spark.createDataFrame([("src/foo.test.js",), ("dist/bundle.js",), ("src/index.js",)], "path string")
    got = [r[0] for r in rows.select(findings.ignore_match(F.col("path"), ["**/*.test.js", "**/dist/**"])).collect()]
    assert got == ["**/*.test.js", "**/dist/**", None]


@pytest.mark.parametrize(("line", "glob"), [("dist/", "**/dist"), ("!keep", ""), ("/root", "**/root"), ("a/b", "**/a/b"), ("", "")])
def test_gitignore(spark, line, glob):
    assert text.gitignore_to_glob(line) == glob == one(spark, text.gitignore_column(F.col("x")), x=line)


def test_versions(spark):
    p = lambda v: one(spark, versions.parse(F.col("v")), v=v)
    assert p("1.0.0-alpha") < p("1.0.0") < p("1.0.1") < p("2.0.0")
    assert p("1.0") is None
    for new, kind in (("2.0.0", "Major"), ("1.1.0", "Minor"), ("1.0.1", "Patch"), ("1.0.0", "None")):
        assert one(spark, versions.update_type(F.col("a"), F.col("b")), a="1.0.0", b=new) == kind
    assert one(spark, versions.update_type(F.col("a"), F.col("b")), a="2.1.0", b="1.5.0") == "None"
    assert one(spark, versions.update_type(F.col("a"), F.col("b"), compat=True), a="2.1.0", b="1.5.0") == "Minor"


@pytest.mark.parametrize(("version", "req", "ok"), [("1.1.0", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("1.5.0", ">=1.0.0 <2.0.0 || 3.x", True), ("3.2.1", "1.x || 3.x", True), ("1.2.5", "1.2.0 - 1.2.4", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.0.0-a", "*", False), ("1.2.3", "~1.2", True)])
def test_ranges(spark, version, req, ok):
    assert versions.in_range(version, req) is ok
    df = spark.createDataFrame([(version, req)], "v string, r string")
    assert df.select(versions.in_range_udf()("v", "r")).first()[0] is ok


def test_checksums(spark):
    assert len(one(spark, registry.sha256_hex(F.col("x")), x="hello world")) == 64
    sri = one(spark, registry.sha512_sri(F.col("x")), x="hello world")
    assert sri.startswith("sha512-")
    for given, ok in ((sri, True), (sri[7:], True), ("sha512-no", False)):
        assert one(spark, registry.verify_sri(F.col("x"), F.col("g")), x="hello world", g=given) is ok


@pytest.mark.parametrize("url", ["https://github.com/facebook/react", "https://github.com/facebook/react.git", "git+https://github.com/facebook/react.git", "git@github.com:facebook/react.git", '{"url": "https://github.com/facebook/react"}'])
def test_repository(spark, url):
    got = spark.createDataFrame([(url,)], "u string").select(*(c.alias(k) for k, c in registry.repository(F.col("u")).items())).first()
    assert tuple(got) == ("facebook", "react", "https://github.com/facebook/react")


def test_repository_elsewhere(spark):
    assert one(spark, registry.repository(F.col("u"))["owner"], u="https://gitlab.com/a/b") is None


def test_changelog(spark):
    body = "intro\n## [1.2.3] - 2024-01-15\n- a\n### Fixed\n- b\n## 1.2.2\n- c"
    rows = registry.segments(spark.createDataFrame([("p", body), ("q", None)], "key string, text string"), "key", "text").orderBy("key", "entry_no").collect()
    assert [(r["key"], r["entry_no"], r["version"], r["date"]) for r in rows] == [("p", 0, None, None), ("p", 1, "1.2.3", "2024-01-15"), ("p", 2, "1.2.2", None), ("q", 0, None, None)]
    assert rows[1]["body"] == "- a\n### Fixed\n- b"


def test_thresholds():
    assert quality.thresholds()["LongFunction"] == 50
    for bad in (0, 10001):
        with pytest.raises(ValueError, match="LongFunction"):
            quality.thresholds({"LongFunction": bad})


def test_paths():
    assert text.normalize_path("a/./b/../c") == "a/c"
    assert text.normalize_path("/../x") == "/x"


def test_sql_functions(spark):
    registry.register_functions(spark)
    assert spark.sql("select format_bytes(1536L), in_range('1.2.0', '^1.0.0')").first() == ("1.5 KB", True)


def test_intervals_admit_what_the_grammar_says(spark):
    """Every range by columns and by the reader of one range at a time."""
    ranges = [
        "1.2.3", "=1.2.3", "^1.2.3", "^0.2.3", "^0.0.3", "^0.0", "^0", "^0.0.0", "~1.2.3", "~1.2", "~1", ">1.2.3", ">1.2", ">1", ">=1.2.3", ">=1", "<1.2.3", "<1.2", "<=1.2.3", "<=1.2", "<=1", "1", "1.2", "1.x", "1.2.*", "*", "", "x", "v1.2.3",
        "1.2.3 - 2.0", "1.2.3 - 2.3.4", ">=1.2.3 <2 || ^3.1.0-beta.2", "<1 || >2 <2.1", ">2 <1", ">=1.2.3-alpha", "<2.0.0-rc.1", "^1.2.3-beta.10", "=1.2.3-beta.2", "latest", "1.2.3.4", "1.a", ">= 1.2 < 1.3", "~0.0.1 || 5.x",
    ]
    tried = ["0.0.0", "0.0.3", "0.0.4", "0.2.3", "0.3.0", "1.0.0", "1.2.2", "1.2.3", "1.2.4", "1.3.0", "2.0.0", "2.0.1", "2.1.0", "2.3.4", "2.3.5", "3.1.0", "5.9.9", "1.2.3-alpha", "1.2.3-beta.2", "1.2.3-beta.10", "1.2.3-rc", "2.0.0-alpha", "2.0.0-rc.1", "3.1.0-beta.3", "1.2.4-alpha", "nope"]
    rows = [(v, r) for v in tried for r in ranges]
    got = spark.createDataFrame(rows, "v string, r string").select("v", "r", versions.admits(F.col("v"), F.col("r")).alias("ok")).collect()
    assert [(r["v"], r["r"]) for r in got if r["ok"] is not versions.in_range(r["v"], r["r"])] == []


def test_best_satisfying(spark):
    asked = spark.createDataFrame([("a", "^1.0.0"), ("a", "<1"), ("a", ">=1.5.0-rc.1 <1.6 || ^3"), ("a", "junk"), ("b", "*"), ("none", "*"), ("a", None), ("a", "^1.0.0")], "package string, req string")
    have = spark.createDataFrame([("a", x) for x in ("0.9.9", "1.0.0", "1.4.9", "1.5.0-rc.2", "2.0.0", "bad")] + [("b", "0.0.1-x"), ("b", None)], "package string, version string")
    got = [(r["package"], r["req"], r["best"]) for r in versions.best_satisfying(asked, have).collect()]
    want = [("a", "^1.0.0", "1.4.9"), ("a", "^1.0.0", "1.4.9"), ("a", "<1", "0.9.9"), ("a", ">=1.5.0-rc.1 <1.6 || ^3", "1.5.0-rc.2"), ("a", "junk", None), ("b", "*", None), ("none", "*", None), ("a", None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_table_functions(spark):
    from graphloom.functions.tables import register_tables

    register_tables(spark)
    body = "intro\n## [1.2.0] - 2024-01-02\n- a\n\n- b\n## v1.1.0-rc.1\n### Fixed\n"
    rows = spark.sql("SELECT e.* FROM {t} t, LATERAL changelog_entries(t.body) e ORDER BY entry_no", t=spark.createDataFrame([(body,)], "body string")).collect()
    assert [tuple(r) for r in rows] == [(0, None, None, "intro"), (1, "1.2.0", "2024-01-02", "- a\n\n- b"), (2, "1.1.0-rc.1", None, "### Fixed\n")]
    logs = spark.createDataFrame([("p", body), ("q", None), ("r", "## 1.0.0\nx")], "key string, text string")
    by_function = spark.sql("SELECT key, e.* FROM {t} t, LATERAL changelog_entries(t.text) e", t=logs)
    by_columns = registry.segments(logs, "key", "text").select("key", F.col("entry_no").cast("int"), "version", "date", "body")
    assert sorted(map(str, by_function.collect())) == sorted(map(str, by_columns.collect()))
    assert [r[0] for r in spark.sql("SELECT pattern FROM brace_expansions('a.{ts,js}{,x}', false)").collect()] == ["a.ts", "a.tsx", "a.js", "a.jsx"]
    with pytest.raises(Exception, match="second argument"):
        spark.sql("SELECT * FROM brace_expansions('a', 1)").collect()

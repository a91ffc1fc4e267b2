import pytest
from pyspark.sql import functions as F

from graphloom.operators import detection, findings, rules
from graphloom.sources import rule_files

ROW = "module_id long, path string, name string, is_type_only boolean, usage_count long, imports array<struct<source:string,names:array<string>,has_default:boolean,has_namespace:boolean>>"


def matches(spark, rule, path="a.ts", name="x", type_only=False, usage=0, imports=()):
    df = spark.createDataFrame([(1, path, name, type_only, usage, list(imports))], ROW)
    return bool(df.where(rules.Rule("r", rule).predicate()).count())


REACT = [("react", ["useState", "useEffect"], False, False)]


def test_names(spark):
    hooks = {"export_pattern": r"^use[A-Z]\w+"}
    assert [matches(spark, hooks, name=n) for n in ("useState", "useEffect", "useeffect", "Component")] == [True, True, False, False]


def test_imports(spark):
    assert matches(spark, {"import_from": ["react", "preact"]}, imports=REACT)
    assert not matches(spark, {"import_from": "react"})
    both = {"import_from": "react", "import_specifiers": ["useState", "useEffect"]}
    assert matches(spark, both, imports=REACT)
    assert not matches(spark, both, imports=[("react", ["useState"], False, False), ("react2", ["useEffect"], False, False)])
    assert not matches(spark, both, imports=[("other", ["useState", "useEffect"], False, False)])
    assert matches(spark, {"import_from": "react", "import_default": True}, imports=[("react", [], True, False)])


def test_usage(spark):
    assert [matches(spark, {"min_usage_count": 2, "max_usage_count": 5}, usage=n) for n in (2, 3, 5, 1, 6, None)] == [True, True, True, False, False, False]
    with pytest.raises(ValueError, match=r"min \(10\) > max \(5\)"):
        rules.Rule("r", {"min_usage_count": 10, "max_usage_count": 5})


def test_limits():
    rules.check_regex("a" * 500)
    with pytest.raises(ValueError, match="longer"):
        rules.check_regex("a" * 501)
    with pytest.raises(ValueError, match="nested"):
        rules.check_regex("(a+)+b")
    with pytest.raises(ValueError, match="overlap"):
        rules.check_regex("(a|a)*b")
    rules.check_regex(r"(ts|js)x?$")
    with pytest.raises(ValueError, match="unknown"):
        rules.Rule("r", {"import_fro": "x"})


def test_file_rule_ends_the_list(spark):
    df = spark.createDataFrame([(1, "a.ts", "x", False, 0, []), (1, "a.ts", "y", False, 0, [])], ROW)
    listed = [rules.Rule("n", {"export_name": "x"}), rules.Rule("f", {"path_ends_with": ".ts"}), rules.Rule("late", {"export_name": "y"})]
    modules, imports = spark.createDataFrame([(1, "a.ts"), (2, "b.ts")], "module_id long, path string"), spark.createDataFrame([], "module_id long, source string, specifier string, name string")
    found = rules.evaluate(df, listed, rules.module_rows(modules, imports))
    # a module without exports is ended too, and each one once
    assert sorted((r["module_id"], r["name"] or "", r["rule"]) for r in found.collect()) == [(1, "", "f"), (1, "x", "n"), (2, "", "f")]
    assert sorted(tuple(r) for r in rules.rule_stats(found).collect()) == [(0, "n", 1, 0), (1, "f", 0, 2)]


def test_own_sections_of_a_rule_file():
    read = rule_files.read_rules('[framework]\nname = "X"\n[[framework.detection]]\ntype = "import"\npattern = "^x$"\n[[rules]]\nname = "r"\nmatch = { path_pattern = "^src/" }\n')
    assert [d.pattern for d in read.detections] == ["^x$"]
    assert read.rules[0].file_only


def test_paths_are_searched_as_they_are(spark):
    assert matches(spark, {"path_pattern": "^src/"}, path="src/a.ts")
    assert not matches(spark, {"not_path_pattern": "^src/"}, path="src/a.ts")


def test_builtin_files():
    files = rule_files.builtin()
    assert [(f.framework, len(f.rules)) for f in files] == [("React", 6), ("Next.js", 9), ("Vue", 2), ("Svelte", 3)]
    order = rule_files.by_precedence(*(f.rules for f in files))
    assert [r.priority for r in order] == sorted((r.priority for r in order), reverse=True)


def test_suppression(spark):
    files = rule_files.builtin()
    imports = spark.createDataFrame([("next",), ("react",), ("vue",)], "source string")
    paths = spark.createDataFrame([], "path string")
    assert sorted(r[0] for r in detection.detect(imports, paths, files).collect()) == ["Next.js", "Vue"]


def test_categories(spark):
    assert findings.validate_categories([], ["files"])[0] == "UseDefaults"
    assert findings.validate_categories(["files"], ["files"])[0] == "AllAvailable"
    assert findings.validate_categories(["files", "types", "no"], ["files"]) == ("PartiallyAvailable", ["files"], ["types"])
    assert findings.validate_categories(["types"], ["files"])[0] == "NoneAvailable"
    assert findings.capabilities(spark, "package", node_modules=True).where("available").count() == 8


def test_kept_and_ignored_are_all(spark):
    df = spark.createDataFrame([("code_smell", "dist/a.js"), ("code_smell", "src/a.js"), ("framework", None)], "type string, path string")
    rows = findings.split_ignored(df, ["src/*"]).collect()
    assert [r["matched_pattern"] for r in rows] == ["**/dist/**", "src/*", None]


def test_export_types(spark):
    df = spark.createDataFrame([("MAX_SIZE", False), ("Widget", False), ("run", False), ("Props", True), ("MAX1_SIZE", False)], "name string, t boolean")
    got = lambda kind: [r[0] for r in df.select(rules.export_type(kind, F.col("name"), F.col("t"))).collect()]
    assert got("const") == [True, False, True, False, False]
    assert got("class") == [True, True, False, False, True]
    assert got("type") == [False, False, False, True, False]


def test_only_imports_that_a_rule_asks_for(spark):
    """Arrays hold the imports that some rule can ask for, and every predicate gives what it gives over all of them."""
    modules = spark.createDataFrame([(k, f"{k}.ts") for k in range(5)], "module_id long, path string")
    exports = modules.select("module_id", F.lit("x").alias("name"), F.lit(False).alias("is_type_only"), F.lit(0).cast("long").alias("usage_count"))
    given = [(0, "react", "Default", "default"), (0, "vue", "Named", "a"), (1, "vue", "Namespace", "*"), (2, "preact", "Named", "b"), (3, "vue/x", "Default", "default")]
    specifiers = spark.createDataFrame(given, "module_id long, source string, specifier string, name string")
    everything = rules.rule_rows(modules, exports, specifiers)
    for match, most in [
        ({"import_from": "react", "import_specifiers": ["default"]}, 1), ({"not_import_from": ["vue", "preact"]}, 1), ({"import_from_pattern": "^vue"}, 1), ({"import_default": True}, 2), ({"export_name": "x"}, 0),
        ({"import_from": ["react"], "not_import_from": ["vue"]}, 2),
    ]:
        rule = rules.Rule("r", match)
        rows = rules.rule_rows(modules, exports, specifiers, [rule])
        ids = lambda df, r=rule: sorted(x["module_id"] for x in df.where(r.predicate()).collect())
        assert ids(rows) == ids(everything)
        assert rows.agg(F.max(F.size("imports"))).first()[0] == most

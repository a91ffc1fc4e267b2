import pytest

from graphloom.operators import findings
from graphloom.operators.rules import Rule
from graphloom.plans import analysis, entries
from graphloom.sources import files, snapshots
from graphloom.sources.rule_files import builtin

PROJECT = {
    "src/index.ts": "import './side'\nimport * as u from './utils'\nimport type { T } from './types'\nexport const main = 1",
    "src/side.ts": "console.log(1)",
    "src/utils.ts": "import { b } from './b'\nexport const u = 1",
    "src/b.ts": "import { u } from './utils'\nexport const b = 1",
    "src/types.ts": "export interface T {}",
    "src/unused.ts": "export const x = 1",
    "dist/bundle.js": "var x = 1",
}


def test_whole_analysis(spark):
    got = analysis.analyze(spark, files.in_memory(spark, PROJECT), analysis.Options(entries=["src/index.ts"], import_patterns=True))
    assert sorted((r["type"], r["path"], r["verdict"]) for r in got.findings.collect()) == [
        ("circular_dependency", "src/b.ts", None), ("namespace_import", "src/index.ts", None), ("side_effect_only_import", "src/index.ts", None),
        ("type_only_import", "src/index.ts", None), ("unreachable_module", "src/unused.ts", "SafeToDelete"), ("unused_export", "src/unused.ts", None),
    ]
    assert [(r["path"], r["matched_pattern"]) for r in got.ignored.collect()] == [("dist/bundle.js", "**/dist/**")]
    assert got.statistics.first()["modules"] == 7
    assert got.errors.count() == 0


WHOLE = {
    "src/index.ts": "import './side'\nimport * as u from './utils'\nimport type { T } from './types'\nimport { a } from './a'\nimport React from 'react'\nconst lazy = () => import('./lazy')\nlazy(React, a, u)",
    "src/side.ts": "console.log(1)",
    "src/utils.ts": "export const u = 1",
    "src/types.ts": "export interface T {}\nexport interface Gone {}",
    "src/lazy.ts": "export default 1",
    "src/a.ts": "import { b } from './b'\nexport const a = b\nexport const left = 2\nconst dead = 3\nfunction many(a, b, c, d, e) { return a }\nmany()",
    "src/b.ts": "import { c } from './c'\nimport { a } from './a'\nexport const b = c + a",
    "src/c.ts": "export * from './star'\nimport { d } from './d'\nexport const c = d",
    "src/star.ts": "export const through = 1",
    "src/d.ts": "import { e } from './e'\nexport const d = e",
    "src/e.ts": "import { f } from './f'\nexport const e = f",
    "src/f.ts": "import { g } from './g'\nexport const f = g",
    "src/g.ts": "import { through } from './c'\nexport const g = 1\nclass Box {\n  private hidden = 1\n  open() { return this.lid }\n  lid = 2\n}\nenum Color { Red, Green = 'g' }\nnew Box(Color.Red, through)",
    "app/page.tsx": "export default function Page() { return null }\nexport const metadata = {}",
    "src/orphan.ts": "import './child'\nexport const x = 1",
    "src/child.ts": "console.log(2)",
}
MANIFEST = '{"name": "n", "version": "1.0.0", "dependencies": {"react": "^18.0.0", "left-pad": "^1.0.0"}}'


def test_every_kind_of_finding(spark):
    options = analysis.options_of(dict.fromkeys(analysis.SWITCHES, True), entries=["src/index.ts"])
    manifests = spark.createDataFrame([("package.json", MANIFEST)], "path string, content string")
    discovered = spark.createDataFrame([(p,) for p in [*WHOLE, "src/huge.ts"]], "path string")
    got = analysis.analyze(spark, files.in_memory(spark, WHOLE), options, manifests, discovered)
    rows = got.findings.collect()
    of = lambda kind: sorted((r["path"], r["name"]) for r in rows if r["type"] == kind)
    assert {r["type"] for r in rows} == set(findings.COUNTED)
    assert of("unused_export") == [("src/a.ts", "left"), ("src/orphan.ts", "x"), ("src/types.ts", "Gone")]
    assert of("framework_export") == [("app/page.tsx", "default"), ("app/page.tsx", "metadata")]
    assert ("src/a.ts", "dead") in of("unused_symbol") and ("src/a.ts", "many") not in of("unused_symbol")
    assert of("unused_private_class_member") == [("src/g.ts", "hidden")]
    assert of("unused_public_class_member") == [("src/g.ts", "open")]
    placed = [r for r in rows if r["type"] in ("unused_symbol", "code_smell", "unused_private_class_member", "unused_public_class_member", "unused_enum_member")]
    assert placed and all(r["line"] and r["column"] is not None and r["offset"] >= r["column"] for r in placed)
    assert of("unused_enum_member") == [("src/g.ts", "Green")]
    assert [(r["path"], r["reason"], r["detail"]) for r in rows if r["type"] == "code_smell"] == [("src/a.ts", "TooManyParameters", "Function 'many' has 5 parameters (recommended: 4)")]
    assert [(r["path"], r["name"]) for r in rows if r["type"] == "unused_npm_dependency"] == [(None, "left-pad")]
    assert of("dead_code_module") == [("src/child.ts", None)]
    assert ("src/index.ts", "src/g.ts") in of("dependency_chain")
    assert of("unreachable_file") == [("src/huge.ts", None)]
    assert of("dynamic_import") == [("src/index.ts", "src/lazy.ts")]
    counted = got.statistics.first()
    assert all(counted[k] == sum(r["type"] == k for r in rows) for k in findings.COUNTED)
    assert counted["type_only_unused_export"] == 1
    assert counted["ignored"]["ignored_findings"] == got.ignored.count() and counted["bundle_impact"] == got.tables["bundle_impact"].first()
    assert all(counted[k] == sorted(got.tables[k].collect()) for k in ("symbol_stats", "member_stats")) and counted["enum_stats"] == got.tables["enum_stats"].first()
    assert sorted(r["framework"] for r in got.tables["frameworks"].collect()) == ["Next.js", "React"]  # suppression works within imports and within paths
    assert all(t.count() for t in got.tables.values())
    report = findings.render_report(got.findings, 2)
    assert "Dependencies: 1\n  unused_npm_dependency left-pad Runtime" in report and "and 3 more" in report


def findings_of(spark, project, **options):
    got = analysis.analyze(spark, files.in_memory(spark, project), analysis.Options(entries=["src/index.ts"], **options)).findings.collect()
    return {kind: sorted((r["path"], r["name"]) for r in got if r["type"] == kind) for kind in {r["type"] for r in got}}


def test_reexports_by_name(spark):
    project = {
        "src/index.ts": "import { alive, ns } from './barrel'\nconst c = require('./common')\nalive(ns, c)",
        "src/barrel.ts": "export { dead } from './x'\nexport { used as alive } from './x'\nexport * as ns from './y'\nexport * from './ring'",
        "src/ring.ts": "export * from './barrel'\nexport const round = 1", "src/x.ts": "export const dead = 1, used = 2", "src/y.ts": "export const { y1, y2 } = z", "src/common.cjs": "exports.a = 1\nmodule.exports.b = 2",
    }
    got = findings_of(spark, project)
    assert got["unused_export"] == [("src/barrel.ts", "dead"), ("src/ring.ts", "round"), ("src/x.ts", "dead")]
    assert "unreachable_module" not in got


def test_rules_on_paths_and_contents(spark):
    project = {"src/index.ts": "import './a'\nimport '../lib/b'", "src/a.ts": "export const y = 1", "lib/b.ts": "// @public\nexport const z = 1, w = 2"}
    rules = [Rule("outside", {"not_path_pattern": "^src/", "export_name": ["y", "z"]}), Rule("marked", {"content_pattern": "@public", "export_name": ["w", "y"]})]
    got = findings_of(spark, project, rules=rules)
    assert got["framework_export"] == [("lib/b.ts", "w"), ("lib/b.ts", "z")]
    assert got["unused_export"] == [("src/a.ts", "y")]
    skip = Rule("skip lib", {"path_starts_with": "/lib"}, {"skip": True})
    assert findings_of(spark, project, rules=[skip, *rules])["unused_export"] == [("lib/b.ts", "w"), ("lib/b.ts", "z"), ("src/a.ts", "y")]


def test_switches():
    got = analysis.options_of({"detect_unused_symbols": True, "symbols": False, "quality": "yes", "detect_enum_members": True, "other": True})
    assert [k for k in analysis.SWITCHES if getattr(got, k)] == ["enum_members"]
    assert not any(getattr(analysis.Options(), k) for k in analysis.SWITCHES)


def test_an_import_more_never_grows_what_is_unreachable(spark):
    dead = lambda project: {r["path"] for r in analysis.analyze(spark, files.in_memory(spark, project), analysis.Options(["src/index.ts"], categories=["files"])).findings.collect()}
    more = dict(PROJECT) | {"src/side.ts": "import './unused'"}
    assert dead(more) <= dead(PROJECT)


def test_entry_patterns(spark):
    rows = spark.createDataFrame([("app/a/page.tsx",), ("middleware.ts",), ("lib/x.ts",), ("x/app/page.tsx",)], "path string")
    got = {r["path"]: r["is_entry"] for r in entries.mark_entries(rows, [], entries.entry_patterns(builtin(), "Next.js")).collect()}
    assert got == {"app/a/page.tsx": True, "middleware.ts": True, "lib/x.ts": False, "x/app/page.tsx": False}


def test_targets(tmp_path):
    assert entries.detect_target([]) == ("package", ["."])
    assert entries.detect_target([str(tmp_path)]) == ("package", [str(tmp_path)])
    assert entries.detect_target(["a.ts", "b.js"])[0] == "files"
    with pytest.raises(ValueError, match="more than"):
        entries.detect_target(["a.ts"] * 1001)
    assert entries.manifest_entries('{"main": "./lib/a.js", "module": "b.mjs"}') == ["lib/a.js", "b.mjs"]


def test_folders(tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("dist/\n!keep\n")
    (tmp_path / "p" / ".gitignore").write_text("/tmp\n")
    assert entries.ignore_globs(str(tmp_path / "p"))[:2] == ["**/tmp", "**/dist"]
    (tmp_path / "package.json").write_text('{"workspaces": ["a/*"]}')
    assert entries.workspace_root(str(tmp_path / "p" / "q")) == (str(tmp_path), ["a/*"])
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'b/*'\n")
    assert entries.workspace_root(str(tmp_path / "p")) == (str(tmp_path), ["b/*"])


def test_projects(tmp_path):
    path = str(tmp_path / "config.toml")
    projects = entries.Projects(path)
    projects.add(entries.Project("one", "One \"x\"", str(tmp_path), members_enabled=["a"]))
    projects.add(entries.Project("two", "Two", "/no/such"))
    projects.enable("two", False)
    projects.save()
    again = entries.Projects(path)
    assert again.items == projects.items
    assert again.validate() == ["two"]
    again.remove("two")
    assert list(again.items) == ["one"]
    for bad in ("", "-a", "a" * 51):
        with pytest.raises(ValueError, match="id"):
            entries.Project(bad, "n", "p")


def test_snapshots(spark):
    rows = [("npm", "react", '{"dist-tags": {"latest": "18.0.0"}, "license": {"type": "MIT"}, "repository": {"url": "git+https://github.com/facebook/react.git"}}'), ("crates.io", "serde", '{"crate": {"max_version": "1.0.0"}}'), ("jsr", "@s/p", "{}"), ("npm", "gone", None)]
    got = {r["package"]: (r["version"], r["license"], r["owner"]) for r in snapshots.latest(spark.createDataFrame(rows, "registry string, package string, body string")).collect()}
    assert got == {"react": ("18.0.0", "MIT", "facebook"), "serde": ("1.0.0", None, None), "@s/p": ("unknown", None, None), "gone": (None, None, None)}
    logs = spark.createDataFrame([("r", "HISTORY.md", "h"), ("r", "CHANGELOG.md", "c"), ("s", "other", "o")], "repo string, name string, content string")
    assert [tuple(r) for r in snapshots.changelog(logs).collect()] == [("r", "CHANGELOG.md", "c")]
    out = snapshots.other_output(spark.createDataFrame([('{"files": ["a.js"], "issues": [{"file": "b.js", "exports": [{"name": "x"}], "dependencies": []}]}',)], "content string"))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == ["('unreachable_file', 'a.js', None)", "('unused_export', 'b.js', 'x')"]

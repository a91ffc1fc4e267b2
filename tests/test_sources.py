import pytest

from graphloom.operators import deps
from graphloom.sources import files, lockfiles
from graphloom.streaming import polling


def content(spark, text):
    return spark.createDataFrame([("f", text)], "path string, content string")


def test_npm_lock(spark):
    rows = lockfiles.npm_lock(content(spark, '{"packages": {"": {"version": "0"}, "node_modules/react": {"version": "18.0.0"}, "node_modules/a/node_modules/b": {"version": "1.0.0"}}}')).collect()
    assert sorted((r["name"], r["version"]) for r in rows) == [("a/node_modules/b", "1.0.0"), ("react", "18.0.0")]


def test_pnpm_lock(spark):
    text = "packages:\n  /react/18.0.0:\n    resolution: {integrity: x}\n  /@s/p/1.0.0: {}\n  vue@3.0.0: {}\n"
    assert sorted((r["name"], r["version"]) for r in lockfiles.pnpm_lock(content(spark, text), compat=True).collect()) == [("@s", "p"), ("react", "18.0.0")]
    assert sorted((r["name"], r["version"]) for r in lockfiles.pnpm_lock(content(spark, text)).collect()) == [("@s/p", "1.0.0"), ("react", "18.0.0"), ("vue", "3.0.0")]


def test_cargo(spark):
    rows = lockfiles.cargo_manifest(content(spark, '[dependencies]\nserde = "1.0"\ntokio = {features = ["full"]}\nbad = 3\n[dev-dependencies]\nx = {git = "u", workspace = true}\n')).collect()
    assert sorted((r["package"], r["version_req"], r["dep_type"], r["name"]) for r in rows) == [("serde", "1.0", "Runtime", "workspace"), ("tokio", "*", "Runtime", "workspace"), ("x", "*", "Development", "workspace")]
    assert lockfiles.cargo_lock(content(spark, '[[package]]\nname = "a"\nversion = "1"\n')).first()["name"] == "a"
    assert lockfiles.yarn_lock(content(spark, "x")).count() == 0
    assert [r["member"] for r in lockfiles.cargo_members(content(spark, '[workspace]\nmembers = ["a", "b/*"]\n')).collect()] == ["a", "b/*"]


def test_npm_manifest(spark):
    rows = deps.manifest_rows(content(spark, '{"name": "n", "version": "1.0.0", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}')).collect()
    assert sorted((r["package"], r["version_req"], r["dep_type"]) for r in rows) == [("a", "^1", "Runtime"), ("b", "2", "Development")]
    assert deps.manifest_rows(content(spark, '{"name": "n"}')).count() == 0


def test_guards():
    for bad in ("/", "/etc", "/usr/lib"):
        with pytest.raises(ValueError, match="refusing"):
            files.check_root(bad)
    for bad in ("/abs.js", "../x.js", "a/*.js"):
        with pytest.raises(ValueError, match="bad entry"):
            files.check_entry(bad)


def test_script():
    imports, exports = files.parse_script("import 'side'\nimport * as utils from './utils'\nimport type { T } from './types'\nimport D, { a as b } from 'pkg'\n// import 'no'\nconst x = () => import('./lazy')\nexport default function f() {}\nexport const y = 1\nexport interface P {}\nexport * from './re'")
    assert imports == [("side", "Static", []), ("./utils", "Static", ["*"]), ("./types", "TypeOnly", ["T"]), ("pkg", "Static", ["a", "default"]), ("./lazy", "Dynamic", []), ("./re", "ReExport", ["*"])]
    assert exports == [("default", "Default", False), ("y", "Named", False), ("P", "TypeOnly", True)]


def test_commonjs_and_patterns():
    text = """const a = require('./a'), z = 1
const { b, k: l, ...rest } = require("./b")
const { m } = require("./m").deep
require('./side')
foo(require('./c').make, obj.require('no'))
exports.three = 3
module.exports.four = () => 4
module.exports = { one, two: 2, five() {} }
const t = import(`./tpl`)
import(`./${no}`)"""
    imports, exports = files.parse_script(text)
    assert imports == [("./a", "Static", ["*"]), ("./b", "Static", ["*"]), ("./m", "Static", ["deep"]), ("./side", "Static", []), ("./c", "Static", ["make"]), ("./tpl", "Dynamic", [])]
    assert [x[0] for x in exports] == ["three", "four", "default"]
    assert [x[0] for x in files.parse_script("module.exports = { one, two: 2 }")[1]] == ["one", "two", "default"]
    text = """export const { p, q: r, s = 1, t: { u }, ...rest } = a, after = 2
export const c: Map<string, number> = new Map(), d = (x, y) => { return [x, y] }
const hidden = 1
export let [h, , { i }] = z;
export namespace N { export const inner = 1 }
export const long =
  1 +
  2, tail = 3"""
    assert [x[0] for x in files.parse_script(text)[1]] == ["p", "r", "s", "u", "rest", "after", "c", "d", "h", "i", "N", "long", "tail"]
    assert files.parse_reexports("export { dead as alive, x } from './x'\nexport * as ns from './y'\nexport * from './z' // export * from 'no'") == [("./x", "alive", "dead"), ("./x", "x", "x"), ("./y", "ns", "*"), ("./z", "*", "*")]


def test_ignore_lines():
    from graphloom.sources.ignore_files import git_regex, inside

    cases = [
        ("gen/", "a/gen", True), ("/gen", "a/gen", False), ("/gen", "gen", True), ("a/b", "x/a/b", False), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True), ("*.log", "x/y.log", True), ("a/*", "a/b/c", False),
        ("**/foo", "x/foo", True), ("foo/**", "foo/a/b", True), ("foo/**", "foo", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("\\#x", "#x", True), ("a?c", "a/c", False), ("x.js  ", "x.js", True),
    ]
    import re

    assert [bool(re.match(git_regex(line)[0], path)) for line, path, _ in cases] == [want for *_, want in cases]
    assert [git_regex(x) for x in ("", "  ", "# no", "/", "!")] == [None] * 5
    assert git_regex("!keep/")[1:] == (True, True)
    assert [inside(x, "a/b") for x in ("*.js", "/a/b/c", "/x", "a/", "/a/b", "!/a/*/d/", "/a/**/e")] == ["*.js", "/c", None, "a/", None, "!/d/", "/**/e"]


def test_discovery_reads_ignore_files(spark, tmp_path):
    repo = tmp_path / "repo"
    root = repo / "app"
    (repo / ".git").mkdir(parents=True)
    texts = {
        "repo/.gitignore": "*.gen.ts\n/app/above/\n/other", "repo/app/.gitignore": "gen/\n*.log.js\n!keep.log.js\n/top.ts\nout/*\n!out/kept.ts", "repo/app/src/.gitignore": "!deep.gen.ts\nlocal.ts",
        "repo/app/src/a.ts": "import './empty'", "repo/app/src/empty.ts": "", "repo/app/gen/x.ts": "1", "repo/app/src/gen/y.ts": "1", "repo/app/a.log.js": "1", "repo/app/keep.log.js": "1", "repo/app/top.ts": "1", "repo/app/src/top.ts": "1",
        "repo/app/out/b.ts": "1", "repo/app/out/kept.ts": "1", "repo/app/z.gen.ts": "1", "repo/app/src/deep.gen.ts": "1", "repo/app/src/local.ts": "1", "repo/app/local.ts": "1", "repo/app/above/c.ts": "1", "repo/app/gen/.gitignore": "!x.ts",
        "repo/app/src/sp ace%41.ts": "1", "away/far.ts": "1",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (root / "link.ts").symlink_to(root / "src" / "a.ts")
    (root / "linked").symlink_to(tmp_path / "away")
    got = files.discover(spark, str(root))
    assert sorted(r["path"] for r in got.collect()) == ["keep.log.js", "local.ts", "out/kept.ts", "src/a.ts", "src/deep.gen.ts", "src/empty.ts", "src/sp ace%41.ts", "src/top.ts"]
    resolved = files.resolve(files.extract_imports(got), got).collect()
    assert [(r["source"], r["resolved_path"]) for r in resolved] == [("./empty", "src/empty.ts")]
    everything = sorted(r["path"] for r in files.discover(spark, str(root), git=False).collect())
    assert "gen/x.ts" in everything and "link.ts" not in everything and "linked/far.ts" not in everything


def test_discovery_and_resolution(spark, tmp_path):
    for name, text in {"src/a.ts": "import './b'\nimport '../lib'\nimport 'react'", "src/b.ts": "export {}", "lib/index.js": "export {}", ".hidden/c.ts": "export {}", "notes.md": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.discover(spark, str(tmp_path))
    assert sorted(r["path"] for r in found.collect()) == ["lib/index.js", "src/a.ts", "src/b.ts"]
    got = {r["source"]: r["resolved_path"] for r in files.resolve(files.extract_imports(found), found).collect()}
    assert got == {"./b": "src/b.ts", "../lib": "lib/index.js", "react": None}
    known = spark.createDataFrame([("src/a.ts",)], "path string")
    assert sorted(r["path"] for r in files.unreachable_files(found, known).collect()) == ["lib/index.js", "src/b.ts"]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    polling.run_available(polling.sessions(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = polling.sessions(events)
    assert 0 < got.count() <= whole.count()
    assert got.exceptAll(whole).count() == 0


def test_parsers_are_spread(spark):
    """A lockfile a row in one partition is parsed in as many tasks as a shuffle has."""
    from graphloom.sources import lockfiles

    files = spark.range(0, 40, 1, 1).selectExpr("concat('f', id) as path", "concat('packages:\\n  p', id, '@1.0:\\n    resolution: {integrity: sha', id, '}\\n') as content")
    rows = lockfiles.pnpm_lock(files)
    assert sorted(r["checksum"] for r in rows.collect()) == sorted(f"sha{k}" for k in range(40))
    assert rows.selectExpr("spark_partition_id() as p").distinct().count() > 1

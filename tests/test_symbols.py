from graphloom.sources.files import parse_script
from graphloom.sources.symbols import parse_symbols

TEXT = """import D, { a as b, type T } from 'http://x//y'
export { q as r, z }
export * as ns from './ns'
export { k as l } from './k'
// function gone() {}
const z = 1
function big(a, b = {x: 1, y: 2}, c, d, e) {
  if (a && b) { for (;;) { while (1) { return `${q}` } } }
  return 1
}
const arrow = async (x: number): Promise<void> => { return x ? 1 : 2 }
const unused = 3
class Foo<T> extends Bar {
  private secret = 1
  #hidden;
  public name: string
  constructor(x) { super(x) }
  get val() { return this.name }
  run(a, b) {
    const local = 2
  }
}
export enum Color { Red, Green = 'g', Blue = 5, Next }
export default big
new Foo().run(Color.Red)
"""


def test_forms_of_imports_and_exports():
    imports, exports = parse_script(TEXT)
    assert imports == [("http://x//y", "Static", ["a", "T", "default"]), ("./ns", "Static", ["*"]), ("./k", "ReExport", ["k"])]
    assert exports == [("ns", "ReExport", False), ("l", "ReExport", False), ("Color", "Named", False), ("default", "Default", False), ("r", "Named", False), ("z", "Named", False)]


def test_symbols_and_their_metrics():
    symbols, _, accesses = parse_symbols(TEXT)
    got = {s["name"]: s for s in symbols}
    assert list(got) == ["z", "big", "arrow", "unused", "Foo", "local", "Color"]
    assert {n for n, s in got.items() if not s["is_used"]} == {"arrow", "unused", "local"}
    assert {n for n, s in got.items() if s["is_exported"]} == {"z", "big", "Color"}
    big = got["big"]
    assert (big["line"], big["raw_kind"], big["line_count"], big["parameter_count"], big["complexity"], big["max_nesting_depth"], big["return_count"]) == (7, "Function", 4, 5, 5, 3, 2)
    assert (got["arrow"]["raw_kind"], got["arrow"]["complexity"]) == ("Function", 2)
    assert (got["Foo"]["method_count"], got["Foo"]["field_count"]) == (3, 3)
    assert accesses == ["Red", "name", "run"]


def test_members():
    _, members, _ = parse_symbols(TEXT)
    assert [(m["name"], m["member_kind"], m["visibility"], m["used_inside"]) for m in members if m["owner"] == "Foo"] == [
        ("secret", "ClassProperty", "private", False), ("#hidden", "ClassProperty", "private", False), ("name", "ClassProperty", "public", True),
        ("constructor", "ClassConstructor", "public", True), ("val", "ClassGetter", "public", False), ("run", "ClassMethod", "public", True),
    ]
    assert [(m["name"], m["enum_value"]) for m in members if m["owner"] == "Color"] == [("Red", "0"), ("Green", '"g"'), ("Blue", "5"), ("Next", "6")]


def test_odd_texts():
    for text in ("", "}}}((", "function", "class X {", "enum E {", "const f = (", "`${", "'", "export {", "function f(", "class A { x = { y: 1 }"):
        parse_symbols(text)
        parse_script(text)


def test_places_of_names():
    text = "// é – 𝔸\nconst über = 'ß', $b = 1\r\n  export function café() { return 1 }\nclass Ö { private ñ = 1; get α() { return 1 } }\nenum E { Ä = 1, B }\n" + TEXT
    for source in (text, TEXT):
        symbols, members, _ = parse_symbols(source)
        lines, data = source.split("\n"), source.encode()
        assert symbols and members
        for x in symbols + members:
            assert lines[x["line"] - 1][x["column"] :].startswith(x["name"]), x
            assert data[x["offset"] :].startswith(x["name"].encode()), x


def test_parts_alone():
    """Imports and symbols that are parsed alone are those of the whole."""
    from graphloom.sources.files import parse_imports

    for text in (TEXT, "import A, { b as c } from 'p'\nexport * as q from 'r'\nexport { s } from 't'\nconst { u } = require('v')\n`import('no')`\nimport(`w`) // import 'no'\n", "", "no marks"):
        assert parse_imports(text, passed_on="ReExport") == parse_script(text, "ReExport")[0]
        assert parse_symbols(text, False) == (*parse_symbols(text)[:2], [])


def test_only_the_fields_that_are_asked_for(spark):
    from graphloom.sources.symbols import scripts

    files = spark.createDataFrame([("a", TEXT), ("b", None)], "path string, content string")
    own = scripts(files, ["symbols"])
    assert own.columns == ["path", "symbols"]
    assert sorted(own.collect()) == sorted(scripts(files).select("path", "symbols").collect())

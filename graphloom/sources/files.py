"""Source files by Spark's binary reader, guards on roots, and a tokenizer for imports and exports of scripts."""

from __future__ import annotations

import os
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions, size and depth limits, and roots that are never scanned.
EXTENSIONS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
MOST_BYTES, MOST_DEPTH = 10 << 20, 100
FORBIDDEN = ("/", "/bin", "/sbin", "/usr", "/etc", "/var", "/sys", "/proc")


def check_root(root: str) -> str:  # A2, A7
    """The normalised root; raises for system folders."""
    path = posixpath.normpath(root)
    if path == "/" or any(path == x or path.startswith(f"{x}/") for x in FORBIDDEN[1:]):
        raise ValueError(f"refusing to scan {path}")
    return path


def discover(spark: SparkSession, root: str, ignores: list[str] | None = None, git: bool = True) -> DataFrame:  # A1, A3, A4, A20
    """(path, length, content) of source files below root: known extensions, at most 10 MiB, no hidden parts, paths relative to root.

    On a file system of the driver's own, symbolic links are left out, files of no bytes are kept (Spark's reader has none of them), and
    ignore files hold as git reads them, those of folders above the root too, unless git is off. Other stores have only the reader's files.
    """
    from graphloom.functions.text import glob_to_regex
    from graphloom.sources import ignore_files

    root = check_root(root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    local = re.sub("^file:/*", "/", root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(local) + "/", "")
    rows = read.where(F.col("length") <= MOST_BYTES).select(relative.alias("path"), "length", F.decode("content", "UTF-8").alias("content"))
    if os.path.isdir(local):
        links, empty, lines = ignore_files.walked(local)
        none = spark.createDataFrame([(x, 0, "") for x in empty], "path string, length long, content string")
        rows = rows.join(spark.createDataFrame([(x,) for x in links], "path string"), "path", "left_anti").unionByName(none)
        for x in links:  # a link to a folder: whatever the reader found below it
            rows = rows.where(~F.col("path").startswith(f"{x}/"))
        if git and lines:
            rows = ignore_files.kept(rows, ignore_files.patterns(spark, lines))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.") & (F.size(F.split("path", "/")) <= MOST_DEPTH) & F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*EXTENSIONS))
    for glob in ignores or []:
        rows = rows.where(~F.col("path").rlike(glob_to_regex(glob)))
    return rows


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:  # A5
    """(path, length, content) from a dictionary."""
    return spark.createDataFrame([(p, len(c.encode()), c) for p, c in files.items()], "path string, length long, content string")


def unreachable_files(discovered: DataFrame, known: DataFrame) -> DataFrame:  # E3, I2
    """Discovered paths that the graph does not hold, as findings of size 0."""
    return discovered.select("path").distinct().join(known.select("path"), "path", "left_anti").withColumn("size", F.lit(0).cast("long"))


def check_entry(path: str) -> str:  # D32
    """A relative entry without wildcards that stays inside its root."""
    if path.startswith("/") or re.search("[*?]", path) or posixpath.normpath(path).startswith(".."):
        raise ValueError(f"bad entry point: {path}")
    return posixpath.normpath(path)


_BLANK = re.compile(r"""(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", re.S)
_MARKED = re.compile(r"""["'`]|/[/*]""")
_IMPORT = re.compile(r"""\bimport\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s*as\s+([\w$]+))?\s*(?:from\s*)?["']([^"']+)["']""")
_DYNAMIC = re.compile(r"""\bimport\s*\(\s*(["'`])([^"'`$]+)\1\s*\)""")
_REQUIRE = re.compile(r"""(?:(?P<line>^[ \t]*)|\b(?:const|let|var)\s+(?P<all>[\w$]+|\{[^}]*\})\s*=\s*|(?<![\w$.]))require\s*\(\s*["'](?P<source>[^"']+)["']\s*\)(?:\.(?P<member>[\w$]+))?""", re.M)
_COMMONJS = re.compile(r"(?<![\w$.])(?:module\.)?exports\.([\w$]+)\s*=(?!=)|(?<![\w$.])module\.exports\s*=(?!=)\s*(\{[^{}]*\})?")
_REEXPORT = re.compile(r"""\bexport\s+(type\s+)?(\*|\{[^}]*\})\s*(?:as\s+([\w$]+)\s+)?from\s*["']([^"']+)["']""")
_LIST = re.compile(r"\bexport\s+(type\s+)?\{([^}]*)\}(?!\s*from\b)")
_EXPORT = re.compile(r"\bexport\s+(default\b)?\s*(?:declare\s+)?(?:async\s+)?(?:(function\*?|class|const\s+enum|enum|interface|type|namespace|module|abstract\s+class)\s+([\w$]+))?")
_NAMESPACE = re.compile(r"\b(?:namespace|module)\s+[\w$.]*\s*\{")
_VALUES = re.compile(r"\bexport\s+(?:declare\s+)?(?:const|let|var)\b(?!\s+enum\b)")


def blank(text: str, strings: bool, templates: bool = True) -> str:
    """The text with comments as blanks, and strings and templates too where asked; every character keeps its place and line."""
    if not _MARKED.search(text):
        return text
    keep = lambda m: m["string"] and not strings or m["template"] and not templates
    return _BLANK.sub(lambda m: m[0] if keep(m) else re.sub(r"[^\n]", " ", m[0]), text)


def _names(text: str) -> list[tuple[str, str]]:
    """(own name, outer name) of each part of a braced list."""
    parts = [re.sub(r"^type\s+", "", x.strip()) for x in text.split(",") if x.strip()]
    return [(x[0], x[-1]) for x in (re.split(r"\s+as\s+", p) for p in parts)]


_OPEN, _CLOSE = "([{", ")]}"


def _group(text: str, at: int) -> int:
    """Where the bracket at `at` closes, or the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in _OPEN) - (text[i] in _CLOSE)
        if not depth:
            return i
    return len(text)


def _parts(text: str) -> list[str]:
    """A list split at its own commas."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in _OPEN) - (c in _CLOSE)
        if c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]


def _bound(pattern: str) -> list[str]:
    """The names that a destructuring pattern binds."""
    out = []
    for part in _parts(pattern.strip()[1:-1]):
        name = part.removeprefix("...").strip()
        if pattern.strip()[0] == "{" and name[:1] not in "{[":
            key, colon, value = name.partition(":")
            name = value.strip() if colon else key
        if name[:1] in ("{", "["):
            out += _bound(name[: _group(name, 0) + 1])
        elif m := re.match(r"[\w$]+", name):
            out.append(m[0])
    return out


def _declared(plain: str, at: int) -> list[str]:
    """The names that const, let or var binds from `at` on: all declarators, patterns included. Ends at a semicolon or where a line does not go on."""
    names, i = [], at
    while m := re.compile(r"\s*([\w$]+|[{\[])").match(plain, i):
        i = m.end()
        if m[1] in "{[":
            i = _group(plain, i - 1) + 1
            names += _bound(plain[m.end() - 1 : i])
        else:
            names.append(m[1])
        depth, typed, more = 0, True, False  # typed: before the equals sign, where angles are brackets
        while i < len(plain) and not more:
            c = plain[i]
            if c in _CLOSE and not depth or c == ";" and not depth:
                return names
            depth += (c in _OPEN or typed and c == "<") - (c in _CLOSE or typed and c == ">" and plain[i - 1] != "=")
            if c == "=" and not depth and plain[i + 1 : i + 2] != ">":
                typed = False
            more = c == "," and not depth
            if c == "\n" and not depth and plain[:i].rstrip()[-1:] not in tuple(",=+-*/&|?:(<") and plain[i:].lstrip()[:1] not in tuple(",=.+-*/&|?:)"):
                return names
            i += 1
        if not more:
            return names
    return names


def parse_reexports(text: str) -> list[tuple]:  # G3
    """(source, name, origin_name) of every name that a script passes on; '*' is every name, or the whole module under a name."""
    out = []
    for m in _REEXPORT.finditer(blank(text, strings=False)):
        out += [(m[4], m[3] or "*", "*")] if m[2] == "*" else [(m[4], b, a) for a, b in _names(m[2][1:-1])]
    return out


def parse_imports(raw: str, text: str | None = None, passed_on: str = "Static") -> list[tuple]:  # A24
    """The imports of parse_script alone; text: what blank() leaves of raw beside strings, where it is known."""
    text = blank(raw, strings=False) if text is None else text
    templates = blank(raw, strings=False, templates=False) if "`" in raw else text
    imports = []
    for m in _IMPORT.finditer(text):
        names = [a for a, _ in _names(m[3] or "")]
        names += ["default"] * bool(m[2]) + ["*"] * bool(m[4])
        imports.append((m[5], "TypeOnly" if m[1] else "Static", names))
    for m in _REQUIRE.finditer(text) if "require" in text else ():
        bound = m["all"] or ""
        names = [m["member"]] if m["member"] else [] if m["line"] is not None else [x.partition(":")[0].partition("=")[0].strip() for x in _parts(bound[1:-1])] if bound[:1] == "{" else ["*"]
        imports.append((m["source"], "Static", ["*"] if any(x.startswith("...") for x in names) else names))
    imports += [(m[2], "Dynamic", []) for m in _DYNAMIC.finditer(templates)] if "import" in templates else []
    for m in _REEXPORT.finditer(text) if "export" in text else ():
        imports.append((m[4], passed_on if m[3] else "ReExport", ["*"]) if m[2] == "*" else (m[4], "ReExport", [a for a, _ in _names(m[2][1:-1])]))
    return imports


def parse_script(text: str, passed_on: str = "Static") -> tuple[list[tuple], list[tuple]]:  # A24
    """Imports (source, kind, names) and exports (name, kind, is_type_only) of a script's text, by tokens: comments and templates are blanked first. Approximate: no scopes, no expressions.

    What is required counts as an import: of the names that are bound or read from it at once, else of the whole module. A whole module
    that is exported under a name is an import of kind `passed_on`.
    """
    plain, raw, text = blank(text, strings=True), text, blank(text, strings=False)
    imports, exports = parse_imports(raw, text, passed_on), []
    for m in _REEXPORT.finditer(text):
        if m[2] == "*":
            exports += [(0, m.start(), m[3], "ReExport", False)] if m[3] else []
        else:
            exports += [(0, m.start(), b, "ReExport", bool(m[1])) for _, b in _names(m[2][1:-1])]
    bodies = [(m.end() - 1, _group(plain, m.end() - 1)) for m in _NAMESPACE.finditer(plain)]
    outer = lambda found: [m for m in found if not any(a < m.start() < b for a, b in bodies)]  # noqa: E731  what a namespace exports is its own
    for m in outer(_EXPORT.finditer(plain)):
        if m[1]:
            exports.append((1, m.start(), "default", "Default", False))
        elif m[3]:
            exports.append((1, m.start(), m[3], "TypeOnly" if m[2] in ("interface", "type") else "Named", m[2] in ("interface", "type")))
    exports += [(1, m.start(), name, "Named", False) for m in outer(_VALUES.finditer(plain)) for name in _declared(plain, m.end())]
    for m in outer(_LIST.finditer(plain)):
        exports += [(2, m.start(), b, "TypeOnly" if m[1] else "Default" if b == "default" else "Named", bool(m[1])) for _, b in _names(m[2])]
    for m in _COMMONJS.finditer(plain):
        own = [m[1]] if m[1] else [x for p in _parts((m[2] or "{}")[1:-1]) if re.fullmatch(r"[\w$]+", x := re.split(r"[:(]", p)[0].strip())]
        exports += [(3, m.start(), name, "Named", False) for name in own] + ([] if m[1] else [(3, m.start(), "default", "Default", False)])
    return imports, list(dict.fromkeys(x[2:] for x in sorted(exports, key=lambda x: x[:2])))


def extract_imports(files: DataFrame) -> DataFrame:  # A24
    """(path, source, kind, names) of files (path, content), resolved later by joining normalised paths."""

    def run(batches):
        for batch in batches:
            out = [(p, *x) for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True) for x in parse_imports(c or "")]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], names=["path", "source", "kind", "names"])

    return files.select("path", "content").mapInArrow(run, "path string, source string, kind string, names array<string>")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_path: a relative source beside its importer, as it stands, with an extension, or as a folder's index; null for packages."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    up = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, x))
    joined = F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, F.col("source")), "/"), F.array().cast("array<string>"), up), "/")
    rows = imports.withColumn("key", F.when(F.col("source").startswith("."), joined))
    plain = F.regexp_replace("path", r"\.[^./]+$", "")
    keys = files.select("path", F.explode(F.array_distinct(F.array(F.col("path"), plain, F.regexp_replace(plain, "/index$", "")))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("resolved_path"))
    return rows.join(first, "key", "left").drop("key")

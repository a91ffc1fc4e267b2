"""Symbols of a script's text: functions, classes, enums and variables with their metrics, and the members of classes and enums.

Approximate, as the tokenizer of files.py: brackets are matched on text without comments and strings, there are no scopes, and a name counts
as used wherever it occurs once more than it is declared, so that a doubt never calls anything unused.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources.files import blank, parse_reexports, parse_script

SYMBOL = "name string, raw_kind string, line int, column int, offset long, is_exported boolean, is_used boolean, line_count int, parameter_count int, method_count int, field_count int, complexity int, max_nesting_depth int, return_count int"
MEMBER = "owner string, owner_kind string, name string, member_kind string, visibility string, enum_value string, line int, column int, offset long, used_inside boolean"
IMPORT = "source string, kind string, names array<string>"
EXPORT = "name string, kind string, is_type_only boolean"
SCRIPT = f"path string, imports array<struct<{IMPORT}>>, exports array<struct<{EXPORT}>>, symbols array<struct<{SYMBOL}>>, members array<struct<{MEMBER}>>, accesses array<string>, reexports array<struct<source:string,name:string,origin_name:string>>"

_DECLARED = re.compile(r"(\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?(?:\babstract\s+|\basync\s+)?\b(function\*?|class|const\s+enum|enum|interface|type|const|let|var)\s+([A-Za-z_$][\w$]*)")
_KIND = {"function": "Function", "function*": "Function", "class": "Class", "enum": "Enum", "interface": "Interface", "type": "TypeAlias"}
_WORD = re.compile(r"#?[A-Za-z_$][\w$]*")
_ACCESS = re.compile(r"""\.\s*(#?[A-Za-z_$][\w$]*)|\[\s*["']([\w$]+)["']\s*\]""")
_ARROW = re.compile(r"\s*(?::[^=;]+)?=\s*(?:async\s+|async(?=\())?(?:function\*?\s*[\w$]*\s*)?(?:<[^>=]*>\s*)?\(")
_LISTED = re.compile(r"\bexport\s+\{([^}]*)\}|\bexport\s+default\s+([\w$]+)")
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.?:])")
_MEMBER = re.compile(
    r"(?:^|(?<=[;}\n]))[ \t\r\f]*(?:@[\w$.]+(?:\(\))?\s*)*((?:(?:public|private|protected|static|readonly|abstract|override|async|declare)\s+)*)(?:(get|set)\s+(?=[#\w$]))?\*?\s*(#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(?:<[^>]*>)?\s*(\(|[=:;]|$|(?=\n|\}))",
)


def _pairs(text: str) -> dict[int, int]:
    """Where each bracket closes; braces, round and square ones are matched apart, and what never closes ends with the text."""
    stacks: dict[str, list[int]] = {"}": [], ")": [], "]": []}
    closing = {"{": "}", "(": ")", "[": "]"}
    out = {}
    for m in re.finditer(r"[(){}\[\]]", text):
        if m[0] in closing:
            stacks[closing[m[0]]].append(m.start())
        elif stacks[m[0]]:
            out[stacks[m[0]].pop()] = m.start()
    return out | {k: len(text) for stack in stacks.values() for k in stack}


def _parameters(text: str) -> int:
    """Parameters in a list without its brackets: commas outside nested brackets part them."""
    depth, n = 0, 0
    for c in text:
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and depth > 0)
        n += c == "," and depth == 0
    return n + bool(text.strip().rstrip(",")) - text.rstrip().endswith(",")


def _nesting(text: str) -> int:
    depth = most = 0
    for m in re.finditer(r"[{}]", text):
        depth += 1 if m[0] == "{" else -1
        most = max(most, depth)
    return most


def _skeleton(text: str, begin: int, end: int, pairs: dict[int, int]) -> tuple[str, list[int]]:
    """Text between begin and end without what stands in brackets, and the place of each of its characters."""
    out, at, k = [], [], begin
    while k < end:
        out.append(text[k])
        at.append(k)
        if k in pairs and pairs[k] < end:
            k = pairs[k]
            out.append(text[k])
            at.append(k)
        k += 1
    return "".join(out), at


def _function(plain: str, end: int, pairs: dict[int, int], is_arrow: bool) -> tuple[str, str] | None:
    """Parameters and body of the function whose name ends at `end`; None if there is none."""
    if is_arrow:
        m = _ARROW.match(plain, end)
    else:
        m = re.compile(r"\s*(?:<[^>(]*>\s*)?\(").match(plain, end)
    if not m:
        return None
    opened = m.end() - 1
    closed = pairs[opened]
    if is_arrow and "function" not in m[0]:
        after = re.compile(r"\s*(?::[^={;\n]+)?=>\s*").match(plain, closed + 1)
        if not after:
            return None
        begin = after.end()
        if plain[begin : begin + 1] != "{":
            stop = plain.find("\n", begin)
            return plain[opened + 1 : closed], plain[begin : stop if stop >= 0 else len(plain)]
    else:
        begin = plain.find("{", closed)
        if begin < 0:
            return None
    return plain[opened + 1 : closed], plain[begin + 1 : pairs[begin]]


def _places(text: str) -> Callable[[int], dict]:  # C4
    """A function from a character's position to its line (from 1), its column in that line (in characters, from 0) and its offset in the text (in bytes of UTF-8)."""
    lines = [m.start() for m in re.finditer("\n", text)]
    wide = [] if text.isascii() else [k for k, c in enumerate(text) if c > "\x7f"]
    more = [0, *accumulate(len(text[k].encode("utf-8", "surrogatepass")) - 1 for k in wide)]

    def place(at: int) -> dict:
        line = bisect_left(lines, at)
        return {"line": line + 1, "column": at - (lines[line - 1] + 1 if line else 0), "offset": at + more[bisect_left(wide, at)]}

    return place


def _members(plain: str, place: Callable[[int], dict], owner: str, begin: int, pairs: dict[int, int], words: Counter) -> list[dict]:
    """Members of the class whose body opens at begin."""
    skeleton, at = _skeleton(plain, begin + 1, pairs[begin], pairs)
    found = []
    for m in _MEMBER.finditer(skeleton):
        modifiers, accessor, name, tail = m[1].split(), m[2], m[3], m[4]
        if not tail and not modifiers and not name.startswith("#"):
            continue
        kind = "ClassGetter" if accessor == "get" else "ClassSetter" if accessor == "set" else "ClassConstructor" if name == "constructor" else "ClassMethod" if tail == "(" else "ClassProperty"
        visibility = "private" if "private" in modifiers or name.startswith("#") else "protected" if "protected" in modifiers else "public"
        found.append({"owner": owner, "owner_kind": "class", "name": name, "member_kind": kind, "visibility": visibility, "enum_value": None, **place(at[m.start(3)])})
    declared = Counter(x["name"] for x in found)
    for x in found:
        x["used_inside"] = x["member_kind"] == "ClassConstructor" or words[x["name"]] > declared[x["name"]]
    return found


def _enum(plain: str, text: str, place: Callable[[int], dict], owner: str, begin: int, pairs: dict[int, int]) -> list[dict]:
    """Members of the enum whose body opens at begin; one without a value counts on from the one before it."""
    found, following, k, end = [], 0, begin + 1, pairs[begin]
    for part in _skeleton(plain, k, end, pairs)[0].split(","):
        name = re.match(r"\s*([A-Za-z_$][\w$]*)", part)
        if name:
            at = plain.find(name[1], k)
            given = re.match(r"[\w$]+\s*=\s*(\"[^\"\n]*\"|'[^'\n]*'|[^,}\n]+)", text[at:end])
            value = given[1].strip() if given else str(following) if following is not None else "computed"
            value = f'"{value[1:-1]}"' if value[:1] == "'" else value
            following = int(value) + 1 if re.fullmatch(r"-?\d+", value) else None
            found.append({"owner": owner, "owner_kind": "enum", "name": name[1], "member_kind": None, "visibility": "public", "enum_value": value, **place(at), "used_inside": False})
            k = at + len(name[1])
    return found


def parse_symbols(text: str, read: bool = True) -> tuple[list[dict], list[dict], list[str]]:  # G6, G7, G8
    """Symbols and members of a script's text as rows of SYMBOL and MEMBER, and the distinct property names it reads (none without read)."""
    code, plain = blank(text, strings=False), blank(text, strings=True)
    place = _places(text)
    pairs, words = _pairs(plain), Counter(_WORD.findall(blank(text, strings=True, templates=False)))
    listed = {x.strip().split(" as ")[0].strip() for m in _LISTED.finditer(plain) for x in (m[1] or m[2]).split(",")}
    heads = []
    for m in _DECLARED.finditer(plain):
        word, name = m[2], m[3]
        before = plain[max(0, m.start() - 80) : m.start()].rstrip()
        if word in ("function", "function*", "class") and not m[1] and (before[-1:] in tuple("=(,:?&|!>[") or re.search(r"\b(?:return|await|new|yield|default)$", before)):
            continue  # an expression's own name
        if word == "type" and not re.compile(r"\s*(?:<[^=]*>)?\s*=").match(plain, m.end()) or name in ("extends", "of", "in"):
            continue
        heads.append((m, "enum" if word.endswith("enum") else word, name))
    declared = Counter(name for _, _, name in heads)
    symbols, members = [], []
    for m, word, name in heads:
        kind = _KIND.get(word, "Variable")
        row = {"name": name, "raw_kind": kind, **place(m.start(3)), "is_exported": bool(m[1]) or name in listed, "is_used": words[name] > declared[name]}
        row |= dict.fromkeys(("line_count", "parameter_count", "method_count", "field_count", "complexity", "max_nesting_depth", "return_count"))
        own = _function(plain, m.end(), pairs, kind == "Variable") if kind in ("Function", "Variable") else None
        if own:
            parameters, body = own
            row |= {
                "raw_kind": "Function", "line_count": body.count("\n") + 1, "parameter_count": _parameters(parameters), "complexity": 1 + len(_BRANCH.findall(body)),
                "max_nesting_depth": _nesting(body), "return_count": len(re.findall(r"\breturn\b", body)),
            }
        begin = plain.find("{", m.end()) if kind in ("Class", "Enum") else -1
        if begin >= 0 and kind == "Class":
            inside = _members(plain, place, name, begin, pairs, words)
            fields = sum(x["member_kind"] == "ClassProperty" for x in inside)
            row |= {"line_count": plain.count("\n", begin, pairs[begin]) + 1, "method_count": len(inside) - fields, "field_count": fields}
            members += inside
        elif begin >= 0:
            members += _enum(plain, code, place, name, begin, pairs)
        symbols.append(row)
    return symbols, members, sorted({a or b for a, b in _ACCESS.findall(blank(text, strings=False, templates=False))}) if read else []


def scripts(files: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:  # A24, G6
    """Everything that is read from the text of files (path, content), a row a file as SCRIPT says; null text is empty. Given fields of it, texts are parsed for those alone."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL(SCRIPT)
    schema = StructType([x for x in whole if fields is None or x.name in ("path", *fields)])
    kept = to_arrow_schema(schema)
    asked = set(schema.names)

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                row = {"path": path}
                if asked & {"imports", "exports"}:
                    imports, exports = parse_script(content or "", "ReExport")
                    row |= {"imports": [dict(zip(("source", "kind", "names"), x, strict=True)) for x in imports], "exports": [dict(zip(("name", "kind", "is_type_only"), x, strict=True)) for x in exports]}
                if asked & {"symbols", "members", "accesses"}:
                    row |= dict(zip(("symbols", "members", "accesses"), parse_symbols(content or "", "accesses" in asked), strict=True))
                if "reexports" in asked:
                    row["reexports"] = [dict(zip(("source", "name", "origin_name"), x, strict=True)) for x in parse_reexports(content or "")]
                rows.append({k: row[k] for k in kept.names})
            yield pa.RecordBatch.from_pylist(rows, schema=kept)

    return files.select("path", "content").mapInArrow(run, schema)

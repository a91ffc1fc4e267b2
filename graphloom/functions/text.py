"""Scalar functions on paths, globs and sizes, as Columns; globs become regular expressions once, when a plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(size: Column) -> Column:  # J1
    """'2.00 MB' from 1 MiB, '1.5 KB' from 1 KiB, else '500 bytes'."""
    mb, kb = size / F.lit(1048576.0), size / F.lit(1024.0)
    return F.when(size >= 1048576, F.format_string("%.2f MB", mb)).when(size >= 1024, F.format_string("%.1f KB", kb)).otherwise(F.concat(size.cast("string"), F.lit(" bytes")))


def expand_braces(pattern: str) -> list[str]:  # J2
    """'a.{ts,js}' gives 'a.ts' and 'a.js'; several braces multiply, left to right."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for choice in m[1].split(",") for x in expand_braces(pattern[: m.start()] + choice + pattern[m.end() :])]


def glob_to_regex(pattern: str, star_crosses: bool = True) -> str:  # J3, D24
    """An anchored regular expression for a glob. '**/' also stands for no directory; a single star crosses '/' unless told otherwise."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*" if star_crosses else "[^/]*"
        elif c == "?":
            out += "." if star_crosses else "[^/]"
        elif c == "{":
            out, depth = out + "(", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r".+()^$|[]\{}" else c
        i += 1
    return f"^{out}$"


def gitignore_to_glob(line: str) -> str:  # D25
    """A line of an ignore file as a glob: negations and blanks give the empty string, everything else matches anywhere."""
    line = line.strip().rstrip("/")
    if not line or line.startswith(("!", "#")):
        return ""
    return f"**/{line.lstrip('/')}"


def gitignore_column(line: Column) -> Column:  # D25
    trimmed = F.rtrim(F.trim(line), F.lit("/"))
    return F.when(trimmed.startswith("!") | trimmed.startswith("#") | (trimmed == ""), F.lit("")).otherwise(F.concat(F.lit("**/"), F.regexp_replace(trimmed, "^/+", "")))


def slug(name: Column) -> Column:  # J16
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}-]", "-")


def package_name(source: Column) -> Column:  # G9
    """The package of an import's source: two segments with a scope, else one."""
    return F.when(source.startswith("@"), F.substring_index(source, "/", 2)).otherwise(F.substring_index(source, "/", 1))


def normalize_path(path: str) -> str:  # J19
    """'.' and '..' resolved without looking at the file system."""
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == ".." and out and out[-1] not in ("", ".."):
            out.pop()
        elif part == ".." and out[:1] == [""]:
            continue
        elif part not in (".", "") or not out and part == "":
            out.append(part)
    return "/".join(out) or ("/" if path.startswith("/") else ".")


def framework_by_content(text: Column) -> Column:  # J18
    has = lambda x: text.contains(x)
    return F.when(has('"next"'), "Next.js").when(has('"@vue/') | has('"vue"'), "Vue").when(has('"svelte"'), "Svelte").when(has('"react"'), "React")


def registry_name(name: Column) -> Column:  # J15
    """A scoped package name as registries want it in a path."""
    return F.when(name.startswith("@"), F.replace(name, F.lit("/"), F.lit("%2f"))).otherwise(name)

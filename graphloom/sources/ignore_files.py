"""Ignore files as git reads them: each pattern holds below its own folder, the last match wins, a negation restores, and nothing below an ignored folder comes back."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = ".gitignore"


def walked(root: str) -> tuple[list[str], list[str], list[tuple[str, int, str]]]:
    """Of a local folder: symbolic links, files of no bytes, and the lines of ignore files as (folder, number, line); folders above the root count up to the repository's."""
    links, empty, lines = [], [], []
    for folder, folders, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        at = lambda x, rel=rel: x if rel == "." else f"{rel}/{x}"
        links += [at(x) for x in (*folders, *names) if os.path.islink(os.path.join(folder, x))]
        folders[:] = [x for x in folders if not x.startswith(".")]
        empty += [at(x) for x in names if not os.path.islink(p := os.path.join(folder, x)) and os.path.isfile(p) and not os.path.getsize(p)]
        if NAME in names:
            lines += [("" if rel == "." else rel, k, x) for k, x in enumerate(Path(folder, NAME).read_text(errors="replace").splitlines())]
    return links, empty, lines_above(root) + lines


def lines_above(root: str) -> list[tuple[str, int, str]]:
    """The lines of ignore files in the folders above root, as they read from root and before every line further down; the outermost first, up to the repository's."""
    lines: list[tuple[str, int, str]] = []
    here, above = os.path.abspath(root), []
    while not os.path.exists(os.path.join(here, ".git")) and os.path.dirname(here) != here:
        below, here = os.path.basename(here), os.path.dirname(here)
        above.append(below)
        if os.path.isfile(p := os.path.join(here, NAME)):
            prefix = "/".join(reversed(above))
            own = [(k, inside(x, prefix)) for k, x in enumerate(Path(p).read_text(errors="replace").splitlines())]
            lines = [("", k - 1_000_000 * len(above), x) for k, x in own if x] + lines
    return lines


def inside(line: str, prefix: str) -> str | None:
    """The line as it reads from the folder `prefix` below: an anchored pattern loses the prefix, or says nothing if it goes elsewhere."""
    text = line.rstrip()
    mark, body = ("!", text[1:]) if text.startswith("!") else ("", text)
    if not body or body.startswith("#"):
        return None
    if "/" not in body.rstrip("/") or body.startswith("**/"):
        return line
    body = body.lstrip("/")
    parts, own = body.rstrip("/").split("/"), prefix.split("/")
    for k, name in enumerate(own):
        if k >= len(parts):
            return None  # names a folder above the root, which was asked for all the same
        if parts[k] == "**":
            return f"{mark}/{'/'.join(parts[k:])}{'/' if body.endswith('/') else ''}"
        if not re.fullmatch(_segment(parts[k]), name):
            return None
    rest = parts[len(own) :]
    return f"{mark}/{'/'.join(rest)}{'/' if body.endswith('/') else ''}" if rest else None


def _segment(glob: str) -> str:
    """A regular expression for one part of a pattern: stars and marks stay within it."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            own = glob[i + 1 : end]
            out += "[" + ("^" + own[1:] if own[0] in "!^" else own).replace("\\", "\\\\") + "]"
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += re.escape(c)
        i += 1
    return out


def git_regex(line: str) -> tuple[str, bool, bool] | None:
    """(regex over paths relative to the file's folder, negated, folders only) of a line; None for comments and blanks."""
    text = re.sub(r"(?<!\\)\s+$", "", line)
    negated = text.startswith("!")
    text = text[1:] if negated else text
    if not text or text.startswith("#") and not negated:
        return None
    folders = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    parts = text.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}$", negated, folders


def patterns(spark: SparkSession, lines: list[tuple[str, int, str]]) -> DataFrame:
    """(folder, number, regex, negated, folders) of lines (folder, number, line)."""
    rows = [(folder, k, *found) for folder, k, line in lines if (found := git_regex(line))]
    return spark.createDataFrame(rows, "folder string, number long, regex string, negated boolean, folders boolean")


def ignored_prefixes(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(prefix) of the paths and folders above them that the patterns ignore: of those that match, the last line of the deepest file decides."""
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(upto(n).alias("prefix"), (n < F.size(parts)).alias("is_folder")))).alias("x")).select("x.*").distinct()
    names = F.split("prefix", "/")
    over = each.select("prefix", "is_folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.struct(F.when(n == 0, "").otherwise(F.array_join(F.slice(names, 1, n), "/")).alias("folder"), n.alias("depth")))).alias("x"))
    rows = over.select("prefix", "is_folder", "x.folder", "x.depth").join(rules, "folder")
    rest = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.substring(F.col("prefix"), F.length("folder") + 2, F.length("prefix")))
    hit = rows.withColumn("rest", rest).where("(is_folder or not folders) and rest rlike regex")
    return hit.groupBy("prefix").agg(F.max_by("negated", F.struct("depth", "number")).alias("negated")).where("not negated").select("prefix")


def kept(rows: DataFrame, rules: DataFrame) -> DataFrame:  # A20, D25
    """The rows (path, ...) that no pattern ignores, neither the path nor a folder above it."""
    parts = F.split("path", "/")
    prefixes = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    gone = prefixes.join(ignored_prefixes(rows.select("path"), rules), "prefix", "left_semi").select("path").distinct()
    return rows.join(gone, "path", "left_anti")

"""The rule language: a rule's table becomes one boolean Column over an export's module, imports and path.

Input rows: module_id, path, name, is_type_only, usage_count, imports ARRAY<STRUCT<source, names ARRAY<STRING>, has_default BOOLEAN,
has_namespace BOOLEAN>> and, for content rules, content. Regular expressions search; they run on a backtracking engine, so ones that
nest quantifiers are refused when a rule is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of rule files and patterns.
MOST_REGEX, MOST_FILE, MOST_DEPTH, MOST_CONTENT = 500, 1 << 20, 10, 10 << 20
KEYS = (
    "import_from", "import_from_pattern", "import_specifiers", "import_default", "import_namespace", "export_name", "export_pattern", "export_type",
    "path_starts_with", "path_ends_with", "path_pattern", "content_pattern", "not_import_from", "not_export_name", "not_export_pattern", "not_path_pattern",
    "min_usage_count", "max_usage_count",
)
EXPORT_KEYS = ("export_name", "export_pattern", "export_type", "not_export_name", "not_export_pattern", "min_usage_count", "max_usage_count")


def check_regex(pattern: str) -> str:  # D18
    """The pattern, if it is short, compiles, nests no unbounded quantifier and repeats no alternatives of which one begins another."""
    if len(pattern) > MOST_REGEX:
        raise ValueError(f"pattern longer than {MOST_REGEX}")
    re.compile(pattern)
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]", pattern):
        raise ValueError(f"nested quantifiers: {pattern}")
    for body in re.findall(r"\(((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*)\)(?:[+*]|\{\d+,\})", pattern):
        ways = sorted(body.removeprefix("?:").split("|"))
        if any(b.startswith(a) for a, b in zip(ways[:-1], ways[1:], strict=True)):
            raise ValueError(f"repeated alternatives overlap: {pattern}")
    return pattern


def _many(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def export_type(kind: str, name: Column, is_type_only: Column) -> Column:  # D8
    """What a name looks like: types only if type-only; functions any name; classes and enums start upper; values start lower or are all upper with an underscore."""
    upper = name.rlike(r"^\p{Lu}")
    if kind in ("type", "interface"):
        return is_type_only
    if kind == "function":
        return ~is_type_only & (name != "")
    if kind in ("class", "enum"):
        return ~is_type_only & upper
    return ~is_type_only & (name != "") & (~upper | (name.rlike("^[A-Z_]+$") & name.contains("_")))


@dataclass(frozen=True)
class Rule:
    """name, priority, match (a table of KEYS), action and reason."""

    name: str
    match: dict
    priority: int = 0
    action: dict = field(default_factory=lambda: {"mark_used": True})
    reason: str = ""

    def __post_init__(self):
        unknown = set(self.match) - set(KEYS)
        if unknown:
            raise ValueError(f"{self.name}: unknown conditions {sorted(unknown)}")
        for k, v in self.match.items():
            if k.endswith("pattern"):
                check_regex(v)
        low, high = self.match.get("min_usage_count"), self.match.get("max_usage_count")
        if low is not None and high is not None and low > high:
            raise ValueError(f"min ({low}) > max ({high})")

    @property
    def file_only(self) -> bool:  # D19
        return not any(k in self.match for k in EXPORT_KEYS)

    @property
    def verb(self) -> str:  # L3
        for k in ("skip", "warn", "severity"):
            if self.action.get(k):
                return k
        return "mark_used"

    def predicate(self, paths: Sequence[Column] = ()) -> Column:
        """All groups of conditions joined by AND; the content condition stands last. Of several spellings of a path one is enough, but a negative condition must hold for all."""
        paths = paths or (F.col("path"),)
        some = lambda test: reduce(Column.__or__, (test(p) for p in paths))
        m, held = self.match, F.lit(True)
        source = lambda i: (i.source.isin(*_many(m["import_from"])) if "import_from" in m else i.source.rlike(m["import_from_pattern"]) if "import_from_pattern" in m else F.lit(True))
        if "import_from" in m:  # D1
            held = held & F.exists("imports", lambda i: i.source.isin(*_many(m["import_from"])))
        if "import_from_pattern" in m:  # D2
            held = held & F.exists("imports", lambda i: i.source.rlike(m["import_from_pattern"]))
        if any(k in m for k in ("import_specifiers", "import_default", "import_namespace")):  # D3-D5, of one and the same import

            def one(i):
                ok = source(i)
                if "import_specifiers" in m:
                    ok = ok & (F.size(F.array_except(F.array(*(F.lit(x) for x in _many(m["import_specifiers"]))), i.names)) == 0)
                if "import_default" in m:
                    ok = ok & (i.has_default == F.lit(m["import_default"]))
                if "import_namespace" in m:
                    ok = ok & (i.has_namespace == F.lit(m["import_namespace"]))
                return ok

            held = held & F.exists("imports", one)
        name = F.col("name")
        if "export_name" in m:  # D6
            held = held & name.isin(*_many(m["export_name"]))
        if "export_pattern" in m:  # D7
            held = held & name.rlike(m["export_pattern"])
        if "export_type" in m:  # D8
            held = held & export_type(m["export_type"], name, F.col("is_type_only"))
        for key, test in (("path_starts_with", Column.startswith), ("path_ends_with", Column.endswith)):  # D9, D10
            if key in m:
                held = held & reduce(Column.__or__, (some(lambda p, x=x, t=test: t(p, x)) for x in _many(m[key])), F.lit(False))
        if "path_pattern" in m:  # D11
            held = held & some(lambda p: p.rlike(m["path_pattern"]))
        if "not_import_from" in m:  # D13
            held = held & ~F.exists("imports", lambda i: i.source.isin(*_many(m["not_import_from"])))
        if "not_export_name" in m:  # D14
            held = held & ~name.isin(*_many(m["not_export_name"]))
        if "not_export_pattern" in m:  # D15
            held = held & ~name.rlike(m["not_export_pattern"])
        if "not_path_pattern" in m:  # D16
            held = held & ~some(lambda p: p.rlike(m["not_path_pattern"]))
        count = F.col("usage_count")
        if "min_usage_count" in m:  # D17: a null count never matches
            held = held & F.coalesce(count >= m["min_usage_count"], F.lit(False))
        if "max_usage_count" in m:
            held = held & F.coalesce(count <= m["max_usage_count"], F.lit(False))
        if "content_pattern" in m:  # D12
            held = held & F.coalesce((F.octet_length("content") <= MOST_CONTENT) & F.col("content").rlike(m["content_pattern"]), F.lit(False))
        return held


def import_arrays(specifiers: DataFrame) -> DataFrame:
    """(module_id, imports) for the rules, from rows (module_id, source, specifier, name)."""
    each = specifiers.groupBy("module_id", "source").agg(
        F.collect_set(F.when(F.col("specifier").isin("Named", "Default"), F.col("name"))).alias("names"),
        F.bool_or(F.col("specifier") == "Default").alias("has_default"), F.bool_or(F.col("specifier") == "Namespace").alias("has_namespace"),
    )
    return each.groupBy("module_id").agg(F.collect_list(F.struct("source", "names", "has_default", "has_namespace")).alias("imports"))


def import_test(rules: Sequence[Rule]) -> Column:
    """Whether some condition of the rules can hold for an import's source: an import that fails it changes no predicate. Without conditions on imports none can."""
    held = F.lit(False)
    for m in (r.match for r in rules):
        if "import_from" in m:
            held = held | F.col("source").isin(*_many(m["import_from"]))
        if "import_from_pattern" in m:
            held = held | F.col("source").rlike(m["import_from_pattern"])
        if "not_import_from" in m:
            held = held | F.col("source").isin(*_many(m["not_import_from"]))
        if any(k in m for k in ("import_specifiers", "import_default", "import_namespace")) and not ("import_from" in m or "import_from_pattern" in m):
            return F.lit(True)
    return held


def _with_imports(rows: DataFrame, specifiers: DataFrame, rules: Sequence[Rule] | None) -> DataFrame:
    empty = F.array().cast("array<struct<source:string,names:array<string>,has_default:boolean,has_namespace:boolean>>")
    read = specifiers if rules is None else specifiers.where(import_test(rules))
    return rows.join(import_arrays(read), "module_id", "left").withColumn("imports", F.coalesce("imports", empty))


def rule_rows(modules: DataFrame, exports: DataFrame, specifiers: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Exports with their module's path and imports, as the rules read them; given rules, only the imports that one of them can ask for."""
    return _with_imports(exports.join(modules.select("module_id", "path"), "module_id"), specifiers, rules)


def module_rows(modules: DataFrame, specifiers: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Modules with their imports, as file rules read them: like an export without a name."""
    rows = _with_imports(modules, specifiers, rules)
    return rows.withColumns({"name": F.lit(None).cast("string"), "is_type_only": F.lit(False), "usage_count": F.lit(None).cast("long")})


def evaluate(rows: DataFrame, rules: list[Rule], modules: DataFrame, paths: Sequence[Column] = ()) -> DataFrame:  # E8, L2, H6
    """rule_idx, rule, verb, file_only of every match: a row for each export and export rule, and one with a null name for each module's first file rule, which ends its list.

    rows: exports as rule_rows() gives them; modules: module_rows(); paths: the spellings of a path that conditions see. What a file rule tests stands in an export's row too, so nothing is joined.
    """
    said = lambda k, r: F.struct(F.lit(k).alias("rule_idx"), F.lit(r.name).alias("rule"), F.lit(r.verb).alias("verb"), F.lit(r.file_only).alias("file_only"))
    files = [(k, r) for k, r in enumerate(rules) if r.file_only]
    first = F.coalesce(*(F.when(r.predicate(paths), said(k, r)) for k, r in files), F.lit(None)) if files else F.lit(None).cast("struct<rule_idx:int,rule:string,verb:string,file_only:boolean>")
    hits = [F.when(r.predicate(paths), said(k, r)) for k, r in enumerate(rules) if not r.file_only]
    names = ("module_id", "path", "name")
    found = modules.select(*names, first.alias("hit")).where("hit is not null")
    if hits:
        own = rows.withColumn("last", first["rule_idx"]).withColumn("hit", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
        found = own.where("last is null or hit.rule_idx < last").select(*names, "hit").union(found)
    return found.select(*names, "hit.*")


def marked_used(matches: DataFrame) -> DataFrame:  # G4, L4
    """Exports that at least one mark_used rule holds for, with the first such rule."""
    return matches.where("verb = 'mark_used' and not file_only").groupBy("module_id", "path", "name").agg(F.min_by("rule", "rule_idx").alias("rule"), F.count("*").alias("rules"))


def rule_stats(matches: DataFrame) -> DataFrame:  # F16
    """Matches of each rule; every export match counts as marked and every module that a file rule ends as skipped, whatever the action."""
    return matches.groupBy("rule_idx", "rule").agg(F.count_if(~F.col("file_only")).alias("marked"), F.count_if("file_only").alias("skipped"))

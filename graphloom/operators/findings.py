"""Findings: categories, ignore patterns, statistics, ranking and reports.

A finding has type, path (null if none), is_type_only, size and an id; other columns travel along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import format_bytes, glob_to_regex

#: Categories in their order, with what they hold.
CATEGORIES = {
    "files": "Unused files that can be deleted",
    "exports": "Unused exports (runtime)",
    "symbols": "Dead code within files",
    "types": "Unused TypeScript types/interfaces",
    "dependencies": "Unused npm packages",
    "imports": "Import pattern analysis",
    "circular": "Circular dependency cycles",
    "quality": "Code quality issues",
    "framework": "Framework-specific exports",
}
FULL_GRAPH = ("files", "exports", "dependencies", "circular", "framework")
TYPE_CATEGORY = {
    "unreachable_file": "files", "unreachable_module": "files", "dead_code_module": "files", "unused_export": "exports",
    "unused_symbol": "symbols", "unused_private_class_member": "symbols", "unused_public_class_member": "symbols", "unused_enum_member": "symbols",
    "unused_npm_dependency": "dependencies", "side_effect_only_import": "imports", "namespace_import": "imports", "type_only_import": "imports",
    "dependency_chain": "imports", "dynamic_import": "imports", "circular_dependency": "circular", "code_smell": "quality", "framework_export": "framework",
}
#: Default ignore globs.
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/.git/**", "**/.next/**", "**/dist/**", "**/build/**", "**/out/**", "**/.dist/**",
    "**/_dist/**", "**/.cache/**", "**/cache/**", "**/coverage/**", "**/.nyc_output/**", "**/.turbo/**",
)
#: The kinds of ignored findings that are counted.
BREAKDOWN = ("unused_export", "unreachable_module", "unreachable_file", "unused_symbol", "framework_export", "module", "dependency", "pattern")
#: Types of findings that have a counter in the statistics.
COUNTED = (
    "unused_export", "unreachable_module", "unreachable_file", "framework_export", "circular_dependency", "dynamic_import", "code_smell", "unused_symbol",
    "unused_private_class_member", "unused_public_class_member", "unused_enum_member", "unused_npm_dependency", "side_effect_only_import", "namespace_import",
    "type_only_import", "dead_code_module", "dependency_chain",
)
PACKAGE_MODE = ("files", "exports", "symbols", "types", "imports", "circular", "quality")
FILES_MODE = ("symbols", "types", "imports", "quality")


def category(kind: Column, is_type_only: Column) -> Column:  # C8
    """A type-only unused export is of the types; unknown types count as framework."""
    table = F.create_map(*(F.lit(x) for kv in TYPE_CATEGORY.items() for x in kv))
    return F.when((kind == "unused_export") & is_type_only, "types").otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("framework")))


def filter_path(kind: Column, path: Column, members: Column) -> Column:  # C9
    """The path that ignore patterns see: a cycle's or chain's first member, nothing for frameworks and packages, else the path."""
    return F.when(kind.isin("circular_dependency", "dependency_chain"), F.try_element_at(F.split(members, ","), F.lit(1))).when(~kind.isin("framework", "unused_npm_dependency"), path)


def export_kind(kind: Column, is_type_only: Column) -> Column:  # C2
    """Kinds of exports in findings: type-only ones first, then as declared, Named by default."""
    return F.when(is_type_only, "TypeOnly").when(kind.isin("Named", "Default", "ReExport", "StarReExport"), kind).otherwise("Named")


def errors_and_warnings(errors: DataFrame, warnings: DataFrame) -> DataFrame:  # C13
    """One frame of (file, message, severity); messages (message) carry no file."""
    tagged = lambda df, severity: df.select(F.lit("unknown").alias("file"), "message", F.lit(severity).alias("severity"))
    return tagged(errors, "Error").unionByName(tagged(warnings, "Warning"))


def with_category(findings: DataFrame) -> DataFrame:
    return findings.withColumn("category", category(F.col("type"), F.col("is_type_only")))


def categories(spark: SparkSession) -> DataFrame:  # C11
    return spark.createDataFrame([(k, n, n.capitalize(), d, n in FULL_GRAPH) for k, (n, d) in enumerate(CATEGORIES.items())], "position int, name string, display string, description string, needs_full_graph boolean")


def category_counts(findings: DataFrame) -> DataFrame:  # F15
    """A row for each category, those without findings too, in their order."""
    counts = with_category(findings).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return categories(findings.sparkSession).join(counts, "name", "left").select("position", "name", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(findings: DataFrame, modules: DataFrame, imports: DataFrame) -> DataFrame:  # C12, F3, F4, F5
    """One row of counters: modules, imports (virtual modules included), distinct external sources, findings of each type."""
    counters = [F.count_if(F.col("type") == t).alias(t) for t in COUNTED] + [F.count_if((F.col("type") == "unused_export") & F.col("is_type_only")).alias("type_only_unused_export")]
    one = F.lit(1).alias("one")
    a = findings.agg(*counters, F.count("*").alias("findings")).withColumn("one", one)
    b = modules.agg(F.count("*").alias("modules"), F.count_if(~F.col("path").startswith("virtual:")).alias("real_modules")).withColumn("one", one)
    c = imports.agg(F.count("*").alias("dependencies"), F.count_distinct(F.when(F.col("is_external"), F.col("source"))).alias("external")).withColumn("one", one)
    return a.join(b, "one").join(c, "one").drop("one")  # a row each


#: Side tables of the statistics row: name -> whether the table has one row (else a row a kind, type or severity: bounded by those).
BLOCKS = {"ignored": True, "bundle_impact": True, "symbol_stats": False, "member_stats": False, "enum_stats": True, "dependency_coverage": False, "smell_stats": False}


def with_blocks(row: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:  # C12
    """The statistics row with a column for each side table, as a scalar subquery: a struct, or an array of structs in their order; null where a table is not given.

    An array of an empty table is empty, the struct of a table without rows is null.
    """
    out = {}
    for name, single in BLOCKS.items():
        if name not in tables:
            out[name] = F.lit(None)
            continue
        table = tables[name]
        each = F.struct(*table.columns)
        out[name] = table.agg((F.first(each) if single else F.array_sort(F.collect_list(each))).alias(name)).scalar()
    return row.withColumns(out)


def ignore_table(spark: SparkSession, patterns: list[str], defaults: bool = True) -> DataFrame:  # D22, D23
    """(idx, pattern, regex). Defaults stand before the given patterns, each put in front of the one before it, so the last default is first."""
    order = [*(reversed(DEFAULT_IGNORES) if defaults else ()), *(p for p in patterns if p)]
    return spark.createDataFrame([(k, p, glob_to_regex(p)) for k, p in enumerate(order)], "idx int, pattern string, regex string")


def ignore_match(path: Column, patterns: list[str], defaults: bool = True) -> Column:  # D24, E10
    """The first pattern that matches, or null: one CASE over literal expressions, so that no join is needed."""
    order = [*(reversed(DEFAULT_IGNORES) if defaults else ()), *(p for p in patterns if p)]
    return reduce(lambda case, p: case.when(path.rlike(glob_to_regex(p)), F.lit(p)), order, F.when(F.lit(False), F.lit(""))) if order else F.lit(None).cast("string")


def split_ignored(findings: DataFrame, patterns: list[str], defaults: bool = True) -> DataFrame:  # D26
    """Adds matched_pattern: null for what is kept; findings without a path are always kept."""
    return findings.withColumn("matched_pattern", ignore_match(F.col("path"), patterns, defaults))


def ignored_breakdown(ignored: DataFrame) -> DataFrame:  # F12
    return ignored.agg(*(F.count_if(F.col("type") == t).alias(t) for t in BREAKDOWN))


def ignored_block(ignored: DataFrame) -> DataFrame:  # C12, F12
    """How many findings are ignored, and the breakdown: one row."""
    return ignored.agg(F.count("*").alias("ignored_findings"), *(F.count_if(F.col("type") == t).alias(t) for t in BREAKDOWN))


def recalculated(findings: DataFrame, patterns: list[str]) -> DataFrame:  # F13
    """Counters after the ignore patterns; stale_ columns hold those of before, which a compatible report would still show for circular_dependency."""
    kept = F.col("matched_pattern").isNull()
    rows = split_ignored(findings, patterns)
    names = ("unused_export", "unreachable_module", "framework_export", "circular_dependency")
    return rows.agg(*(F.count_if(kept & (F.col("type") == t)).alias(t) for t in names), *(F.count_if(F.col("type") == t).alias(f"stale_{t}") for t in names))


def retain(findings: DataFrame, wanted: list[str]) -> DataFrame:  # D27
    return with_category(findings).where(F.col("category").isin(*wanted) if wanted else F.lit(True))


def capabilities(spark: SparkSession, mode: str, node_modules: bool = False, framework: bool = False) -> DataFrame:  # D29, C15
    """name, available and the reason where it is not, of every category."""
    rows = []
    for name in CATEGORIES:
        if mode == "package":
            ok = name in PACKAGE_MODE or name == "dependencies" and node_modules or name == "framework" and framework
            why = None if ok else "node_modules not found" if name == "dependencies" else "no framework detected"
        else:
            ok = name in FILES_MODE
            why = None if ok else "requires package.json" if name == "framework" else "requires full graph"
        rows.append((name, ok, why))
    return spark.createDataFrame(rows, "name string, available boolean, reason string")


def validate_categories(requested: list[str], available: list[str]) -> tuple[str, list[str], list[str]]:  # D28
    """UseDefaults, AllAvailable, PartiallyAvailable or NoneAvailable, with the granted and refused names. Unknown names vanish."""
    asked = [x for x in requested if x in CATEGORIES]
    if not asked:
        return "UseDefaults", list(available), []
    granted, refused = [x for x in asked if x in available], [x for x in asked if x not in available]
    return ("AllAvailable" if not refused else "PartiallyAvailable" if granted else "NoneAvailable"), granted, refused


def partition_categories(requested: DataFrame, capable: DataFrame) -> DataFrame:  # D28
    """Requested names (name) against capabilities: granted, refused, with the reason; unknown ones vanish."""
    return requested.select("name").distinct().join(capable, "name").select("name", F.when(F.col("available"), "granted").otherwise("refused").alias("outcome"), "reason")


def union_findings(parts: list[DataFrame]) -> DataFrame:  # I1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_per_group(rows: DataFrame, group: str, by: str, k: int, tie: str) -> DataFrame:  # H1, H5, B3
    """The k largest of each group with their rank, the group's size and how many are not shown."""
    ranked = Window.partitionBy(group).orderBy(F.desc(by), tie)
    sizes = rows.groupBy(group).agg(F.count("*").alias("in_group"))
    best = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)  # the engine limits each group before the shuffle
    return best.join(sizes, group).withColumn("more", F.greatest(F.col("in_group") - k, F.lit(0)))


def files_section(modules: DataFrame) -> DataFrame:  # B3, J1
    """The report's files: ten safe and ten others by size, with readable sizes."""
    best = top_per_group(modules, "has_side_effects", "size", 10, "path")
    return best.select("has_side_effects", "rank", "path", format_bytes(F.col("size")).alias("shown"), "more")


def exports_section(exports: DataFrame) -> DataFrame:  # B4
    """The first 50 runtime exports by path and name, grouped by module; ten modules shown."""
    first = exports.where(~F.col("is_type_only")).orderBy("path", "name").limit(50)
    grouped = first.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"), F.count("*").alias("n"))
    return grouped.orderBy("path").limit(10)


def json_rows(findings: DataFrame) -> DataFrame:  # B1
    """Each finding as a JSON object with its category."""
    own = with_category(findings)
    return own.select("finding_id", F.to_json(F.struct(*sorted(own.columns))).alias("json"))


def report_sections(findings: DataFrame, most: int = 10, tie: str = "path") -> DataFrame:  # B5
    """The largest findings of each category, at most so many, with their rank and how many more there are; ties by `tie`."""
    best = top_per_group(with_category(findings), "category", "size", most, tie)
    return best.drop("in_group")


def render_report(findings: DataFrame, most: int = 10) -> str:  # B2, B5
    """The counts of each category and its first findings as text, in the categories' order, from the aggregated rows alone."""
    rows = {r["name"]: r for r in category_counts(findings).collect()}
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "name", "detail") if c in findings.columns]
    line = findings.withColumn("shown", F.concat_ws(" ", "type", *(F.when(x != "", x) for x in shown)))
    sections = report_sections(line, most, "shown").orderBy("rank").collect()  # at most `most` rows a category
    out = []
    for name in CATEGORIES:
        if rows[name]["n"]:
            own = [r for r in sections if r["category"] == name]
            out += [f"{name.capitalize()}: {rows[name]['n']}", *(f"  {r['shown']}" for r in own)] + ([f"  and {own[0]['more']} more"] if own[0]["more"] else [])
    return "\n".join(out) or "No findings"


def exit_status(errors: int, entries: int, available: int) -> int:  # B8
    return int(errors > 0 or entries == 0 or available == 0)

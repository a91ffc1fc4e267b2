"""From a folder of source files to findings, statistics and ignored findings: the whole analysis as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import chains, deps, detection, findings, graph, quality, rules
from graphloom.plans.entries import entry_patterns, mark_entries
from graphloom.sources import files as sources
from graphloom.sources.rule_files import builtin
from graphloom.sources.symbols import scripts
from graphloom.storage import cut


@dataclass
class Options:  # L7
    """What to analyse. Switches that are off leave their part out of the plan; files, exports, cycles and dynamic imports are always in."""

    entries: list[str] = field(default_factory=list)
    ignores: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    use_ignores: bool = True
    rules: list[rules.Rule] = field(default_factory=list)
    thresholds: dict[str, int] = field(default_factory=dict)
    symbols: bool = False
    quality: bool = False
    class_members: bool = False
    enum_members: bool = False
    npm_dependencies: bool = False
    import_patterns: bool = False
    dead_code_modules: bool = False
    dependency_chains: bool = False


SPAN = ("column", "offset")
SWITCHES = ("symbols", "quality", "class_members", "enum_members", "npm_dependencies", "import_patterns", "dead_code_modules", "dependency_chains")


def options_of(given: dict, **other) -> Options:  # L7
    """Options of a table of switches, by their names with or without detect_, and detect_unused_symbols; what is not a boolean counts as off."""
    own = {("symbols" if k == "detect_unused_symbols" else k.removeprefix("detect_")): v for k, v in given.items()}
    short = {"symbols", "quality"} & set(given)  # the short names come before the old ones
    return Options(**{k: (given[k] if k in short else own.get(k)) is True for k in SWITCHES}, **other)


@dataclass
class Result:
    """findings, what the ignore patterns hide, one row of counters and of what the side tables say, errors, and lazy tables by name in `tables`."""

    findings: DataFrame
    ignored: DataFrame
    statistics: DataFrame
    errors: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Graph:
    """Modules (ids are the paths), resolved imports, specifiers, star re-exports, exports, symbols, members and read property names."""

    modules: DataFrame
    imports: DataFrame
    specifiers: DataFrame
    reexports: DataFrame
    exports: DataFrame
    symbols: DataFrame
    members: DataFrame
    accesses: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.imports.where("resolved_to is not null").select(F.col("module_id").alias("src"), F.col("resolved_to").alias("dst"))


def graph_of(files: DataFrame, entries: list[str]) -> Graph:
    """The code graph of files (path, length, content): the texts are read once, and what they hold is written to the shared folder."""
    read = cut(scripts(files), "scripts")
    marked = mark_entries(files.select("path", "length"), entries, entry_patterns(builtin()))
    effects = read.select("path", (F.size("exports") == 0).alias("has_side_effects"))
    modules = marked.join(effects, "path").select(F.col("path").alias("module_id"), "path", F.col("length").alias("size"), "is_entry", "has_side_effects")
    rows = read.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    resolved = sources.resolve(rows, files)
    imports = cut(resolved.select(F.col("path").alias("module_id"), F.col("resolved_path").alias("resolved_to"), "source", "kind", F.col("resolved_path").isNull().alias("is_external"), "names"), "imports")
    each = imports.where("kind <> 'ReExport'").select("module_id", "resolved_to", "source", "kind", F.explode_outer("names").alias("name"))
    passed = sources.resolve(read.select("path", F.explode("reexports").alias("r")).select("path", "r.*"), files)
    specifier = F.when(F.col("name").isNull(), "None").when(F.col("name") == "*", "Namespace").when(F.col("name") == "default", "Default").otherwise("Named")
    out = lambda field: read.select(F.col("path").alias("module_id"), "path", F.explode(field).alias("x")).select("module_id", "path", "x.*")
    return Graph(
        cut(modules, "modules"), imports, each.withColumns({"specifier": specifier, "name": F.coalesce("name", F.lit(""))}),
        cut(passed.select(F.col("path").alias("module_id"), "name", F.col("resolved_path").alias("origin"), "origin_name").where("origin is not null"), "reexports"),
        out("exports").drop("path").withColumn("usage_count", F.lit(None).cast("long")), out("symbols").withColumn("symbol_id", F.concat_ws(":", "path", "line", "name")), out("members"),
        read.select(F.explode("accesses").alias("name")).distinct(),
    )


def framework_exports(g: Graph, own: list[rules.Rule], files: DataFrame) -> DataFrame:  # G4, G18
    """(module_id, name, rule, framework) of exports that a rule marks as used: built-in rules in their order, then the given ones. Rules know each path relative to the root and with the root's slash; a row stands for one module. Texts are joined only where a rule reads them."""
    every = [r for f in builtin() for r in f.rules] + own
    rooted = F.concat(F.lit("/"), "path")
    rows, modules = rules.rule_rows(g.modules, g.exports, g.specifiers), rules.module_rows(g.modules, g.specifiers)
    tested = rows
    if any("content_pattern" in r.match for r in every):  # D12
        texts = files.select(F.col("path").alias("module_id"), "content")
        tested, modules = rows.join(texts, "module_id"), modules.join(texts, "module_id")
    marked = rules.marked_used(rules.evaluate(tested, every, modules, (F.col("path"), rooted)))
    named = detection.export_framework(rows.withColumn("path", rooted), builtin()).select("module_id", "name", "framework").distinct()
    return marked.groupBy("module_id", "name").agg(F.min("rule").alias("rule")).join(named, ["module_id", "name"])


def member_rows(g: Graph) -> DataFrame:  # G7, G8
    """Members with is_used: a private one within its file, any other where some file reads a property of its name."""
    read = g.accesses.withColumn("read", F.lit(True))
    rows = g.members.join(read, "name", "left")
    used = F.col("used_inside") | F.when(F.col("visibility") == "private", F.lit(False)).otherwise(F.coalesce("read", F.lit(False)))
    return rows.withColumn("is_used", used).drop("read")


def analyze(spark: SparkSession, files: DataFrame, options: Options | None = None, manifests: DataFrame | None = None, discovered: DataFrame | None = None) -> Result:
    """Findings of type, path, name, is_type_only, size, line (from 1), column (in characters, from 0), offset (in bytes), verdict, reason and detail.

    files: (path, length, content). manifests: (path, content) of package manifests, for unused packages. discovered: (path) of source files
    found; those that are not in files are unreachable files. A module that is imported dynamically counts as used whole, since what is
    taken from it can't be seen.
    """
    options = options or Options()
    g = graph_of(files, options.entries)
    modules, imports, edges = g.modules, g.imports, g.edges
    inner = imports.where("resolved_to is not null")
    dead = cut(graph.with_safety(graph.unreachable_modules(modules, edges), inner), "unreachable")
    fields = ("name", "size", "line", "column", "offset", "verdict", "reason", "detail")
    base = lambda df, kind: df.select(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), "path", F.col("is_type_only") if "is_type_only" in df.columns else F.lit(False).alias("is_type_only"), *(c for c in fields if c in df.columns))
    by = lambda test: imports.where(test).select(F.col("module_id").alias("path"), F.col("source").alias("name"))
    cycles = graph.cycle_summary(graph.components(edges), modules, dead).select(F.col("scc_id").alias("path"), F.col("total_size").alias("size"), F.col("members").alias("detail"))

    whole = F.when(F.col("kind") == "Dynamic", "Namespace").otherwise(F.col("specifier"))
    taken = g.specifiers.withColumns({"specifier": whole, "kind": F.when(F.col("kind") == "Dynamic", "Static").otherwise(F.col("kind"))})
    framework = cut(framework_exports(g, options.rules, files), "framework")
    unused = graph.unused_exports(modules, g.exports, taken, g.reexports).join(framework.select("module_id", "name"), ["module_id", "name"], "left_anti")
    unused = unused.withColumn("detail", findings.export_kind(F.col("kind"), F.col("is_type_only")))
    dynamic = graph.dynamic_imports(modules, imports)
    parts = [
        base(dead, "unreachable_module"), base(cycles, "circular_dependency"), base(unused, "unused_export"),
        base(framework.select(F.col("module_id").alias("path"), "name", F.col("framework").alias("detail")), "framework_export"),
        base(dynamic.select(F.col("from_path").alias("path"), F.col("to_path").alias("name"), F.col("to_size").alias("size")), "dynamic_import"),
    ]
    tables = {"bundle_impact": graph.bundle_impact(dead), "frameworks": detection.detect(imports, modules.select(F.concat(F.lit("/"), "path").alias("path")), builtin()), "dynamic_by_parent": graph.dynamic_by_parent(dynamic)}
    if discovered is not None:
        parts.append(base(sources.unreachable_files(discovered, modules), "unreachable_file"))
    if options.symbols:
        symbols = g.symbols.withColumn("kind", quality.symbol_kind(F.col("raw_kind")))
        parts.append(base(quality.unused_symbols(symbols, *SPAN).withColumn("detail", F.col("kind")), "unused_symbol"))
        tables["symbol_stats"] = quality.symbol_stats(symbols)
    if options.quality:
        smells = quality.smells(g.symbols.withColumn("kind", quality.symbol_kind(F.col("raw_kind"))), options.thresholds, SPAN)
        parts.append(base(smells.withColumns({"detail": F.col("message"), "reason": F.col("smell"), "verdict": F.col("severity")}), "code_smell"))
        tables["smell_stats"] = quality.smell_stats(smells)
    if options.class_members:
        members = member_rows(g).where("owner_kind = 'class'")
        kind = F.when(F.col("visibility") == "private", "unused_private_class_member").otherwise("unused_public_class_member")
        parts.append(base(quality.unused_members(members, "line", *SPAN).withColumn("detail", F.concat_ws(" ", "owner", "member")), kind))
        tables["member_stats"] = quality.member_stats(members)
    if options.enum_members:
        enums = member_rows(g).where("owner_kind = 'enum'")
        shown = F.concat_ws(" ", "owner", "value_kind", "value")
        parts.append(base(quality.unused_enum_members(enums, "line", *SPAN).withColumn("detail", shown), "unused_enum_member"))
        tables["enum_stats"] = quality.enum_stats(enums)
    if options.npm_dependencies and manifests is not None:
        declared = cut(deps.manifest_rows(manifests), "declared")
        packages = deps.unused_packages(declared, imports).select(F.lit(None).cast("string").alias("path"), F.col("package").alias("name"), F.col("dep_type").alias("detail"))
        parts.append(base(packages, "unused_npm_dependency"))
        tables["dependency_coverage"] = deps.coverage(declared, imports)
    if options.import_patterns:
        parts += [
            base(by("kind = 'Static' and size(names) = 0"), "side_effect_only_import"), base(by("array_contains(names, '*') and kind = 'Static'"), "namespace_import"),
            base(by("kind = 'TypeOnly'").withColumn("is_type_only", F.lit(True)), "type_only_import"),
        ]
    if options.dead_code_modules:
        parts.append(base(graph.dead_modules(modules, edges.distinct()), "dead_code_module"))
    if options.dependency_chains:
        summary = chains.chain_summary(modules.where("is_entry").select("module_id"), edges)
        deep = chains.unfold(summary, summary.where("greatest(depth, longest) > 5"))  # D36
        parts.append(base(deep.select(F.col("chain")[0].alias("path"), F.col("module_id").alias("name"), F.array_join("chain", ">").alias("detail")), "dependency_chain"))
        tables["chains"] = summary
    found = cut(findings.union_findings(parts), "findings")
    split = findings.split_ignored(found, options.ignores) if options.use_ignores else found.withColumn("matched_pattern", F.lit(None).cast("string"))
    kept = findings.retain(split.where("matched_pattern is null").drop("matched_pattern"), options.categories)
    ignored = split.where("matched_pattern is not null")
    statistics = findings.with_blocks(findings.statistics(found, modules, imports), {k: v for k, v in (tables | {"ignored": findings.ignored_block(ignored)}).items() if k in findings.BLOCKS})
    errors = spark.createDataFrame([] if options.entries or modules.where("is_entry").limit(1).count() else [("unknown", "no entry points", "Error")], "file string, message string, severity string")
    return Result(kept, ignored, statistics, errors, tables)

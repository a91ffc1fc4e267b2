"""Operators over modules and imports: reachability, cycles, chains, dead code, usage.

Frames: modules (module_id, path, size, has_side_effects, is_entry), imports (module_id, resolved_to, kind, source, ...),
edges (src, dst), exports (module_id, name, ...). Fixpoints are rounds of joins whose lineage is cut in the shared folder (fixpoints.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoints import components, reachable
from graphloom.operators.liveness import unused_exports
from graphloom.storage import cut

__all__ = ["components", "reachable", "unused_exports"]

#: Fragments that make a file name a configuration file's.
CONFIG_FRAGMENTS = ("package.json", "tsconfig.json", "jsconfig.json", ".eslintrc", ".prettierrc", "next.config", "vite.config", "rollup.config")


def not_virtual(path: Column) -> Column:  # D20
    return ~path.startswith("virtual:")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_config(path: Column) -> Column:  # D30
    out = F.lit(False)
    for x in CONFIG_FRAGMENTS:
        out = out | basename(path).contains(x)
    return out


def unreachable_modules(modules: DataFrame, edges: DataFrame, jumps: bool = True) -> DataFrame:  # G2
    seen = reachable(modules.where("is_entry").select("module_id"), edges, jumps)
    return modules.where(not_virtual(F.col("path"))).join(seen, "module_id", "left_anti")


def safety(is_dynamic_target: Column) -> dict[str, Column]:  # G17
    """verdict and reason, the first that holds: entry, configuration file, dynamic target, side effects, else safe."""
    said = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    case = F.when(F.col("is_entry"), said("Unsafe", "Entry point")).when(is_config(F.col("path")), said("Unsafe", "Configuration file"))
    case = case.when(is_dynamic_target, said("ReviewCarefully", "Dynamically imported")).when(F.col("has_side_effects"), said("ReviewCarefully", "Module has side effects"))
    case = case.otherwise(said("SafeToDelete", ""))
    return {"verdict": case["verdict"], "reason": case["reason"]}


def dynamic_targets(imports: DataFrame) -> DataFrame:
    return imports.where("kind = 'Dynamic'").select(F.col("resolved_to").alias("module_id")).distinct()


def with_safety(modules: DataFrame, imports: DataFrame) -> DataFrame:  # E4, E5, G17
    flagged = modules.join(dynamic_targets(imports).withColumn("dynamic", F.lit(True)), "module_id", "left")
    return flagged.withColumns(safety(F.coalesce("dynamic", F.lit(False)))).drop("dynamic")


def module_dependencies(modules: DataFrame, imports: DataFrame) -> DataFrame:  # C1, E1
    """Each non-virtual module with its resolved targets, sorted; virtual targets are left out, unresolved ones go by their source."""
    to = modules.select(F.col("module_id").alias("resolved_to"), F.col("path").alias("to_path"))
    target = imports.join(to, "resolved_to", "left").select("module_id", F.coalesce("to_path", "source").alias("target")).where(not_virtual(F.col("target")))
    grouped = target.groupBy("module_id").agg(F.array_join(F.sort_array(F.collect_list("target")), ",").alias("targets"), F.count("*").alias("n_targets"))
    return modules.where(not_virtual(F.col("path"))).join(grouped, "module_id", "left").select("path", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("targets", F.lit("")).alias("targets"))


def resolved_imports(modules: DataFrame, imports: DataFrame) -> DataFrame:  # E1, E2
    """Import edges with both paths; neither may be virtual."""
    a = modules.select("module_id", F.col("path").alias("from_path"))
    b = modules.select(F.col("module_id").alias("resolved_to"), F.col("path").alias("to_path"), F.col("size").alias("to_size"))
    return imports.join(a, "module_id").join(b, "resolved_to").where(not_virtual(F.col("from_path")) & not_virtual(F.col("to_path")))


def dynamic_imports(modules: DataFrame, imports: DataFrame) -> DataFrame:  # G16
    return resolved_imports(modules, imports).where("kind = 'Dynamic'").select("from_path", "to_path", "to_size", (~F.col("is_external")).alias("creates_chunk"))


def dynamic_by_parent(dynamic: DataFrame) -> DataFrame:  # F14, E11
    """Dynamic imports grouped by importer, with the bytes that loading lazily can save."""
    return dynamic.groupBy("from_path").agg(F.count("*").alias("n"), F.sum("to_size").alias("lazy_bytes"), F.array_join(F.sort_array(F.collect_list("to_path")), ",").alias("targets"))


def bundle_impact(unreachable: DataFrame) -> DataFrame:  # F2, E14
    """One row: bytes that deletion saves, and the part without side effects; null when nothing is unreachable."""
    safe = F.sum(F.when(~F.col("has_side_effects"), F.col("size")).otherwise(0))
    return unreachable.agg(F.count("*").alias("modules"), F.sum("size").alias("total_bytes"), safe.alias("safe_bytes"))


def specifier_imports(modules: DataFrame, specifiers: DataFrame, which: str) -> DataFrame:  # G11, G12, G13
    rows = specifiers.join(modules.select("module_id", "path"), "module_id").where(not_virtual(F.col("path")))
    test = {"side_effect": (F.col("specifier") == "None") & (F.col("kind") == "Static"), "namespace": F.col("specifier") == "Namespace", "type_only": F.col("kind") == "TypeOnly"}[which]
    return rows.where(test).select("path", "source", "name", "line")


def cycle_summary(cycles: DataFrame, modules: DataFrame, unreachable: DataFrame) -> DataFrame:  # E6, E7, F10
    """Of each cycle: length, total size, whether all members are unreachable, members by basename (J17)."""
    dead = unreachable.select("module_id").withColumn("dead", F.lit(True))
    rows = cycles.join(modules, "module_id").join(dead, "module_id", "left")
    return rows.groupBy("scc_id").agg(
        F.count("*").alias("length"), F.sum("size").alias("total_size"), F.bool_and(F.coalesce("dead", F.lit(False))).alias("all_unreachable"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("module_id", "path"))), lambda x: basename(x.path)), " -> ").alias("members"),
    )


def chains(entries: DataFrame, edges: DataFrame, over: int = 5) -> DataFrame:  # G15, D36
    """All simple import paths from entries of more than `over` edges, however long: (module_id, depth, chain of ids joined by '>').

    Rounds of one edge until none is left, each written to the shared folder. The paths themselves are the result, and a graph of many
    branches has exponentially many; nothing is cut.
    """
    step = cut(edges.select("src", "dst").distinct(), "edges")
    paths, found, depth = entries.select(F.col("module_id").alias("node"), F.array("module_id").alias("path")).distinct(), [], 0
    while True:
        depth += 1
        paths = cut(paths.join(step, paths["node"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "paths")
        if not paths.limit(1).count():
            break
        if depth > over:
            found.append(paths.select(F.col("node").alias("module_id"), F.lit(depth).alias("depth"), F.array_join(F.col("path").cast("array<string>"), ">").alias("chain")))
    kind = entries.schema["module_id"].dataType.simpleString()
    return reduce(DataFrame.union, found) if found else entries.sparkSession.createDataFrame([], f"module_id {kind}, depth int, chain string")


def dead_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:  # G14
    """Modules that something imports, and only unreachable modules do: importers of an unreachable module are themselves unreachable, so one pass decides."""
    edges = cut(edges.select("src", "dst"), "edges")  # read by the search and for the importers
    seen = reachable(modules.where("is_entry").select("module_id"), edges).withColumn("live", F.lit(True))
    importers = edges.join(seen.withColumnRenamed("module_id", "src"), "src", "left").groupBy(F.col("dst").alias("module_id")).agg(F.count("*").alias("importers"), F.bool_or(F.coalesce("live", F.lit(False))).alias("any_live"))
    return modules.where(~F.col("is_entry") & not_virtual(F.col("path"))).join(importers.where("not any_live"), "module_id").select("module_id", "path", "importers")


def export_split(exports: DataFrame) -> DataFrame:  # F17
    return exports.agg(F.count_if(~F.col("is_type_only")).alias("runtime"), F.count_if("is_type_only").alias("type_only"))

"""Which exports are alive, by name: uses travel backwards over re-exports, renamed and by star, until no new (module, name) is found.

Frames: exports (module_id, name, kind, is_type_only); specifiers (resolved_to, specifier, name, kind); reexports (module_id, name, origin,
origin_name), where name '*' passes on every name but default, and origin_name '*' under a name of its own hands out the whole module.
The name '*' of a live row stands for all names of the module except default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import cut, release

WHOLE = ("*", "default")


def _whole(name: Column, specifier: Column | None = None) -> Column:
    """The names that a use takes: a namespace takes all of a module's."""
    return F.explode(F.when(name == "*" if specifier is None else specifier == "Namespace", F.array(*(F.lit(x) for x in WHOLE))).otherwise(F.array(name)))


def with_names(reexports: DataFrame) -> DataFrame:
    """Re-exports of four columns; those of (module_id, origin) alone are by star."""
    if "name" in reexports.columns:
        return reexports.select("module_id", "name", "origin", "origin_name").where("origin is not null").distinct()
    return reexports.select("module_id", F.lit("*").alias("name"), "origin", F.lit("*").alias("origin_name")).distinct()


def live_exports(entries: DataFrame, exports: DataFrame, specifiers: DataFrame, reexports: DataFrame) -> DataFrame:  # G3
    """(module_id, name) that imports or entries (module_id) take, from the module itself or over any number of re-exports.

    A module's own and named exports hide the same name of its star re-exports. Each round only follows what the round before found; a ring
    of re-exports ends, as nothing is followed twice.
    """
    passed = cut(with_names(reexports), "reexports")
    named, stars = passed.where("name <> '*'"), passed.where("name = '*'").select("module_id", "origin").distinct()
    hides = cut(exports.select("module_id", "name").union(named.select("module_id", "name")).distinct().join(stars.select("module_id").distinct(), "module_id", "left_semi"), "own_names")
    taken = specifiers.where("specifier in ('Named', 'Default', 'Namespace') and kind <> 'Dynamic' and resolved_to is not null")
    begin = taken.select(F.col("resolved_to").alias("module_id"), _whole(F.col("name"), F.col("specifier")).alias("name"))
    whole = entries.select("module_id", F.explode(F.array(*(F.lit(x) for x in WHOLE))).alias("name"))
    seen = front = cut(begin.union(whole).distinct(), "live")
    while True:
        by_name = front.join(named, ["module_id", "name"]).select("origin", "origin_name")
        by_whole = front.where("name = '*'").select("module_id").join(named.where("name <> 'default'"), "module_id").select("origin", "origin_name")
        own = by_name.union(by_whole).select(F.col("origin").alias("module_id"), _whole(F.col("origin_name")).alias("name"))
        through = front.where("name <> 'default'").join(hides, ["module_id", "name"], "left_anti").join(stars, "module_id").select(F.col("origin").alias("module_id"), "name")
        fresh = cut(own.union(through).distinct().join(seen, ["module_id", "name"], "left_anti"), "live")
        if not fresh.limit(1).count():
            release(passed, hides)
            return seen
        both = cut(seen.union(fresh), "live_all")
        seen, front = both, fresh


def unused_exports(modules: DataFrame, exports: DataFrame, specifiers: DataFrame, reexports: DataFrame) -> DataFrame:  # G3
    """Exports of modules that are no entries which nothing takes, re-exports among them: one that nobody imports keeps nothing alive."""
    live = live_exports(modules.where("is_entry").select("module_id"), exports, specifiers, reexports)
    rest = exports.join(modules.where(~F.col("is_entry") & ~F.col("path").startswith("virtual:")).select("module_id", "path"), "module_id").join(live, ["module_id", "name"], "left_anti")
    whole = live.where("name = '*'").select("module_id").withColumn("whole", F.lit(True))
    return rest.join(whole, "module_id", "left").where("whole is null or name = 'default'").select("module_id", "path", "name", "kind", "is_type_only")
